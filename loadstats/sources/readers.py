"""Scans and sinks (S1-S9): CSV, globbed files, JSON, schema checks, writers.

Readers take an explicit schema where the layout is known (no inference pass
over large inputs). Writers go to the shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local temporary folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists, scratch_path

DEMAND_SCHEMA = T.StructType([T.StructField("city", T.StringType()),
                              T.StructField("timestamp", T.TimestampNTZType()),
                              T.StructField("demand", T.DoubleType())])

WEATHER_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampNTZType()),
                               T.StructField("temperature", T.DoubleType()),
                               T.StructField("humidity", T.DoubleType()),
                               T.StructField("wind_speed", T.DoubleType()),
                               T.StructField("pressure", T.DoubleType())])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """Header CSV with an explicit schema (inference only when none is given)."""
    r = spark.read.option("header", header).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def scan_glob(spark: SparkSession, pattern: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Many files by glob; every row keeps its source file name, and the
    number of files matched (from the file listing, no data read) is reported."""
    r = spark.read.schema(schema)
    df = r.option("header", True).csv(pattern) if fmt == "csv" else r.format(fmt).load(pattern)
    n_files = len(df._jdf.inputFiles())       # the listing stays in the JVM; only its length is read
    return df.select("*", F.col("_metadata.file_path").alias("source_file"),
                     F.lit(n_files).alias("files_in_scan"))


def scan_weather_json(spark: SparkSession, pattern: str, schema: T.StructType = WEATHER_SCHEMA,
                      multiline: bool = False, city_regex: str = r"city=([^/]+)/") -> DataFrame:
    """S3: JSON weather files, the city taken from the file path; union over files."""
    df = spark.read.schema(schema).option("multiLine", multiline).json(pattern)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), city_regex, 1).alias("city"), "*")


def flatten_json_column(df: DataFrame, col: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parse a JSON text column with a fixed schema and flatten its fields."""
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_j")).select(*keep, "_j.*")


def flatten_nested(df: DataFrame, array_col: str = "hourly") -> DataFrame:
    """An object with an array of records -> one row per record."""
    return df.select(F.explode(F.col(array_col)).alias("_r")).select("_r.*")


def require_columns(df: DataFrame, required: Sequence[str], allow_empty: bool = False) -> DataFrame:
    """Reject a source lacking required columns or holding no rows."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if not allow_empty and df.isEmpty():
        raise ValueError("source is empty")
    return df


def load_sources(spark: SparkSession, paths: Sequence[str], required: Sequence[str], fmt: str = "parquet",
                 schema: T.StructType | None = None, log=print) -> DataFrame:
    """S5 + J2: read every source that exists, is not empty and has the required
    columns; report and skip the others; union the rest by name (UNION ALL)."""
    frames = []
    for p in paths:
        if not path_exists(spark, p):
            log(f"skipping {p}: missing")
            continue
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True)
        df = r.load(p)
        missing = [c for c in required if c not in df.columns]
        if missing:
            log(f"skipping {p}: lacks {missing}")
            continue
        if df.isEmpty():
            log(f"skipping {p}: empty")
            continue
        frames.append(df.select(*required))
    if not frames:
        raise ValueError("no usable source")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_available(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The first existing source in preference order (Hadoop FS existence test)."""
    for p in paths:
        if path_exists(spark, p):
            return spark.read.format(fmt).load(p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> str:
    """Overwrite a table, partitioned (e.g. by city) for pruning on read."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    w.format(fmt).save(path)
    return path


def append_run_log(metrics: DataFrame, path: str, run_id: str, features: Sequence[str] = (),
                   sizes: dict[str, int] | None = None) -> None:
    """One log row per run (rows of each split, best model, features) appended to a parquet table."""
    best = metrics.agg(F.min_by("model", F.struct("mae", "model")).alias("best_model"),
                       F.min("mae").alias("best_mae"), F.sum("n").alias("rows_scored"))
    (best.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("logged_at"), "*",
                 F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("features"),
                 F.create_map(*[F.lit(x) for kv in (sizes or {}).items() for x in kv]).cast("map<string,bigint>")
                 .alias("dataset_sizes"))
         .write.mode("append").parquet(path))


# ------------------------------------------------------------ round trips used by the registered queries

def roundtrip_csv(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = write_table(df, scratch_path(spark, "s1_csv"), fmt="csv")
    return scan_csv(spark, path, DEMAND_SCHEMA)


def roundtrip_glob(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = write_table(df.select("timestamp", "demand", "city"), scratch_path(spark, "s2_glob"), ["city"], fmt="csv")
    schema = T.StructType(DEMAND_SCHEMA.fields[1:])
    out = scan_glob(spark, f"{path}/city=*/*.csv", schema)
    return out.select(F.regexp_extract("source_file", r"city=([^/]+)/", 1).alias("city"), "timestamp", "demand",
                      "source_file", "files_in_scan")


def roundtrip_weather_json(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = write_table(df, scratch_path(spark, "s3_json"), ["city"], fmt="json")
    return scan_weather_json(spark, f"{path}/city=*/*.json")


def write_tables_roundtrip(spark: SparkSession, merged: DataFrame) -> DataFrame:
    """The four outputs (load, daily, weekly, clean), each a table partitioned by city, and
    the rows that each has for every city when read back."""
    from ..operators.anomaly import clean_dataset
    from ..operators.rollup import daily_summary, weekly_summary
    from ..session import materialize
    root = scratch_path(spark, "s7_tables")
    merged = materialize(merged)                # read by all four outputs
    numeric = [c for c, t in merged.dtypes if t == "double"]
    outputs = {"load": merged, "daily": daily_summary(merged), "weekly": weekly_summary(merged),
               "clean": clean_dataset(merged, numeric)}
    sizes = None
    for name, df in outputs.items():
        back = spark.read.parquet(write_table(df, f"{root}/{name}", ["city"]))
        one = back.groupBy("city").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output"), "city", "rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes


def write_metrics_roundtrip(spark: SparkSession, hourly: DataFrame) -> DataFrame:
    from ..operators import models
    from ..operators.rollup import regression_metrics
    from ..operators.sample import split_chronological
    preds = models.naive_forecast(hourly).withColumn("model", F.lit("naive"))
    metrics = regression_metrics(preds, by="model")
    root = scratch_path(spark, "s8_metrics")
    write_table(metrics, f"{root}/json", fmt="json")            # computed once ...
    written = spark.read.schema(metrics.schema).json(f"{root}/json")
    write_table(written, f"{root}/csv", fmt="csv")              # ... the other sinks copy the written table
    parts = split_chronological(hourly).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["split"]: r["n"] for r in parts.collect()}           # one row a split
    append_run_log(written, f"{root}/run_log", run_id="naive-day", features=["demand_lag_24h"], sizes=sizes)
    log = spark.read.parquet(f"{root}/run_log")
    return written.join(log.select(F.col("best_model").alias("model"), "dataset_sizes"), "model", "left").select(
        *written.columns, F.col("dataset_sizes")["train"].alias("train_rows"), F.col("dataset_sizes")["test"].alias("test_rows"))


def model_roundtrip(spark: SparkSession, merged: DataFrame) -> DataFrame:
    """Fit on scaled columns, save the bundle (model, scaler, weights), reload and score with it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    from ..operators.models import SERVE_SECOND_FACTOR, SERVE_WEIGHTS, assemble
    from ..operators.scale import minmax_stats, minmax_transform
    from .bundle import ENSEMBLE, WEIGHTS_SCHEMA, load_bundle, save_bundle, served
    cols = ["temperature", "humidity", "wind_speed", "pressure"]
    feats = [f"{c}_scaled" for c in cols]
    fitted = minmax_stats(merged, cols)
    model = Pipeline(stages=[assemble(feats), LinearRegression(featuresCol="features", labelCol="demand")]).fit(
        minmax_transform(merged, fitted, cols))
    weights = spark.createDataFrame([(ENSEMBLE, *SERVE_WEIGHTS, SERVE_SECOND_FACTOR)], WEIGHTS_SCHEMA)
    b = load_bundle(spark, save_bundle(spark, scratch_path(spark, "s9_bundle"), model, feats, fitted, weights))
    scored = b.model.transform(minmax_transform(merged, b.scaler, cols))
    return served(scored, b.weights, ENSEMBLE, out="prediction").select("city", "timestamp", "demand", "prediction")
