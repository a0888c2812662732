"""Model bundles (S9) and the ensemble weights table.

A bundle is a folder: the fitted pipeline, the scaler's statistics and the ensemble weights
in a folder of their own, and a manifest that names them. The parts are written first, under
a fresh name, and the manifest last, so a reader never sees half a bundle and a bundle that
is saved again switches over at once. Loading fails if any part is absent.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

PARTS = ("model", "scaler", "weights")
WEIGHTS_SCHEMA = "model string, w_0 double, w_1 double, second_factor double"
# The names that have their own bounds; any other name means the ensemble.
SINGLE_MODELS = ("xgboost",)
ENSEMBLE = "ensemble"


@dataclass
class Bundle:
    model: PipelineModel
    features: list[str]
    scaler: dict[str, float]
    weights: DataFrame


def save_bundle(spark: SparkSession, path: str, model: PipelineModel, features: Sequence[str],
                scaler: Mapping[str, float], weights: DataFrame) -> str:
    """Writes a bundle below ``path``; ``scaler`` is what :func:`scale.minmax_stats` returns."""
    own = f"parts-{uuid.uuid4().hex[:12]}"
    model.write().overwrite().save(f"{path}/{own}/model")
    rows = [(k, None if v is None else float(v)) for k, v in scaler.items()]
    spark.createDataFrame(rows, "name string, value double").coalesce(1).write.parquet(f"{path}/{own}/scaler")
    weights.coalesce(1).write.parquet(f"{path}/{own}/weights")
    manifest = [(own, list(PARTS), list(features))]
    (spark.createDataFrame(manifest, "folder string, parts array<string>, features array<string>").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest"))
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The bundle below ``path``; ``FileNotFoundError`` names the first part that is absent."""
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"{path} has no complete manifest")
    m = spark.read.parquet(f"{path}/manifest").first()
    done = {"model": "model/metadata", "scaler": "scaler/_SUCCESS", "weights": "weights/_SUCCESS"}
    for part in m["parts"]:
        if not path_exists(spark, f"{path}/{m['folder']}/{done[part]}"):
            raise FileNotFoundError(f"{path}: the bundle lacks its {part}")
    root = f"{path}/{m['folder']}"
    scaler = {r["name"]: r["value"] for r in spark.read.parquet(f"{root}/scaler").collect()}    # two numbers a column
    return Bundle(PipelineModel.load(f"{root}/model"), list(m["features"]), scaler, spark.read.parquet(f"{root}/weights"))


def weights_table(grid: DataFrame, model: str = ENSEMBLE, second_factor: float = 1.0) -> DataFrame:
    """The best pair of a weight grid (L6) as a row of the weights table."""
    return grid.where("is_best").select(F.lit(model).alias("model"), F.col("w_a").alias("w_0"), F.col("w_b").alias("w_1"),
                                        F.lit(float(second_factor)).alias("second_factor"))


def write_weights(rows: DataFrame, path: str) -> str:
    """Puts rows into the weights table at ``path``: they replace those of the same model."""
    spark = rows.sparkSession
    rows = rows.select("model", *[F.col(c).cast("double").alias(c) for c in ("w_0", "w_1", "second_factor")])
    if path_exists(spark, f"{path}/_SUCCESS"):
        held = spark.read.schema(WEIGHTS_SCHEMA).parquet(path).join(rows.select("model"), "model", "left_anti")
        kept = [tuple(r) for r in held.unionByName(rows).collect()]        # one row a model name
        rows = spark.createDataFrame(kept, WEIGHTS_SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def chosen_model(name: str | None) -> str:
    """The model that a requested name stands for: an unknown name means the ensemble."""
    return name if name in SINGLE_MODELS else ENSEMBLE


def served(preds: DataFrame, weights: DataFrame, name: Column | str, out: str = "predicted",
           default: tuple[float, float, float] = (0.7, 0.3, 0.9)) -> DataFrame:
    """Predictions as the requested model serves them, and the ``model`` that it is.

    ``name`` is a column or a literal. A single model serves its prediction as it is, the
    ensemble ``p * (w_0 + second_factor * w_1)`` with the weights of its row in the table,
    joined by model name, or ``default`` where the table has none."""
    asked = F.lit(name) if isinstance(name, str) else name
    model = F.when(asked.isin(*SINGLE_MODELS), asked).otherwise(F.lit(ENSEMBLE))
    table = weights.select(F.col("model").alias("_w_model"), "w_0", "w_1", "second_factor")
    joined = preds.withColumn("model", model).join(table, F.col("model") == F.col("_w_model"), "left")
    w0, w1, f = (F.coalesce(F.col(c), F.lit(d)) for c, d in zip(("w_0", "w_1", "second_factor"), default))
    value = F.when(F.col("model").isin(*SINGLE_MODELS), F.col(out)).otherwise(F.col(out) * (w0 + f * w1))
    return joined.withColumn(out, value).drop("_w_model", "w_0", "w_1", "second_factor")
