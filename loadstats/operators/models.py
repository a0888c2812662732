"""Forecast tables, metrics and MLlib models.

Prediction tables are long and keyed: (city, timestamp, actual, predicted[, model]).
Estimators are MLlib (distributed); closed-form fits (ridge) are one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import scalars
from .frames import framed
from .sample import TRAIN_SHARE
from .scale import standardize

# Fixed values from the reference: 24-row naive horizon, ridge alpha 0.5,
# weight options, serving weights 0.7 / 0.3 with the 0.9 factor, bound factors.
NAIVE_HORIZON = 24
RIDGE_ALPHA = 0.5
WEIGHT_OPTIONS = [(0.8, 0.2), (0.5, 0.5), (0.2, 0.8)]
SERVE_WEIGHTS = (0.7, 0.3)
SERVE_SECOND_FACTOR = 0.9
BOUNDS = {"xgboost": (0.9, 1.1), "ensemble": (0.85, 1.15)}
KMEANS_SEED = 42


def naive_forecast(df: DataFrame, col: str = "demand", horizon: int = NAIVE_HORIZON, test_only: bool = True,
                   **kw) -> DataFrame:
    """L1: prediction = value ``horizon`` rows earlier (lag taken before the split);
    rows without history are dropped; by default only the chronological test slice."""
    from .frames import POS, computed_once, join_null_safe, with_position
    base = computed_once(df)                    # one position pass, one size table
    positioned = with_position(base, materialize=False)
    lagged = framed(positioned, lambda w: [F.lag(col, horizon).over(w).alias("predicted")], back=horizon,
                    positioned=True, **kw)
    if test_only:
        sizes = base.groupBy("city").agg(F.count(F.lit(1)).alias("_n"))
        lagged = join_null_safe(lagged, sizes, ["city"]).where(F.col(POS) >= F.floor(F.col("_n") * F.lit(TRAIN_SHARE)))
    return lagged.where(F.col("predicted").isNotNull()).select(
        "city", "timestamp", F.col(col).alias("actual"), "predicted")


def ridge_fit(df: DataFrame, xs: Sequence[str], y: str, alpha: float = RIDGE_ALPHA) -> dict:
    """Ridge with intercept on two inputs, closed form from one aggregate.

    Centred normal equations (X'X + alpha I) b = X'y with X'X and X'y from
    population covariances times n; intercept = mean(y) - mean(x) . b.
    """
    a, b = xs
    st = scalars(df, [F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
                      F.avg(y).alias("my"), F.covar_pop(a, a).alias("saa"), F.covar_pop(a, b).alias("sab"),
                      F.covar_pop(b, b).alias("sbb"), F.covar_pop(a, y).alias("say"),
                      F.covar_pop(b, y).alias("sby")])
    n = st["n"]
    s11, s12, s22 = st["saa"] * n + alpha, st["sab"] * n, st["sbb"] * n + alpha
    r1, r2 = st["say"] * n, st["sby"] * n
    det = s11 * s22 - s12 * s12
    c1 = (s22 * r1 - s12 * r2) / det
    c2 = (s11 * r2 - s12 * r1) / det
    return {"coef_a": c1, "coef_b": c2, "intercept": st["my"] - st["ma"] * c1 - st["mb"] * c2, "n": n}


def ridge_expr(fit: dict, xs: Sequence[str]) -> Column:
    return F.lit(fit["intercept"]) + F.lit(fit["coef_a"]) * F.col(xs[0]) + F.lit(fit["coef_b"]) * F.col(xs[1])


def weight_grid(df: DataFrame, a: str, b: str, actual: str = "actual",
                options: Sequence[tuple] = WEIGHT_OPTIONS) -> DataFrame:
    """MAE of every weight pair over the prediction table, best flagged.

    The option list is a fixed handful, so all MAEs come from one aggregate.
    """
    aggs = [F.avg(F.abs(F.col(actual) - (F.lit(wa) * F.col(a) + F.lit(wb) * F.col(b)))).alias(f"m{i}")
            for i, (wa, wb) in enumerate(options)]
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*aggs)
    best = F.array_min(F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.lit(i).alias("i"))
                                 for i in range(len(options))]))["i"]
    rows = F.array(*[F.struct(F.lit(float(wa)).alias("w_a"), F.lit(float(wb)).alias("w_b"),
                              F.col(f"m{i}").alias("mae"), (best == F.lit(i)).alias("is_best"))
                     for i, (wa, wb) in enumerate(options)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def serve_ensemble(pred: Column, weights: Sequence[float] = SERVE_WEIGHTS,
                   factor: float = SERVE_SECOND_FACTOR) -> Column:
    """P * (w0 + factor * w1)."""
    return pred * F.lit(weights[0] + factor * weights[1])


def confidence_bounds(pred: Column, model: str = "xgboost") -> tuple[Column, Column]:
    """lower = max(0, p*lo) and upper = p*hi; NaN/NULL prediction -> 0."""
    lo, hi = BOUNDS.get(model, BOUNDS["ensemble"])
    p = F.coalesce(F.nanvl(pred, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), p * F.lit(lo)), p * F.lit(hi)


def forecast_table(preds: DataFrame, model: str = "xgboost") -> DataFrame:
    """Keyed forecast rows with bounds and the per-model point count."""
    lower, upper = confidence_bounds(F.col("predicted"), model)
    return preds.select(F.lit(model).alias("model"), "city", "timestamp", "actual",
                        F.coalesce(F.nanvl("predicted", F.lit(0.0)), F.lit(0.0)).alias("predicted"),
                        lower.alias("lower"), upper.alias("upper"))


def within_margin_rate(df: DataFrame, margin: float = 0.1, actual="actual", predicted="predicted",
                       by=None) -> DataFrame:
    """Share of predictions within margin * |actual|."""
    ok = (F.abs(F.col(actual) - F.col(predicted)) <= F.lit(margin) * F.abs(F.col(actual))).cast("int")
    valid = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    aggs = [F.avg(ok).alias("within_rate"), F.count(F.lit(1)).alias("n")]
    return valid.groupBy(by).agg(*aggs) if by else valid.agg(*aggs)


def rolling_origin_folds(df: DataFrame, n_folds: int = 5, start: float = 0.5, by="city",
                         order: str = "timestamp") -> DataFrame:
    """Expanding-window folds by position: fold f tests positions
    [floor(n*(start+(f-1)*step)), floor(n*(start+f*step))), step=(1-start)/n_folds."""
    from .frames import POS, computed_once, join_null_safe, with_position
    base = computed_once(df)
    sizes = base.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    keys = [by] if isinstance(by, str) else list(by)
    p = join_null_safe(with_position(base, by, order, materialize=False), sizes, keys)
    step = (1.0 - start) / n_folds
    fold = F.lit(None).cast("int")
    for f in range(n_folds, 0, -1):
        lo = F.floor(F.col("_n") * F.lit(start + (f - 1) * step))
        hi = F.floor(F.col("_n") * F.lit(start + f * step))
        fold = F.when((F.col(POS) >= lo) & (F.col(POS) < hi), F.lit(f)).otherwise(fold)
    return p.withColumn("fold", fold).drop(POS, "_n")


# ---------------------------------------------------------------- MLlib models

def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    """P15."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def train_boosted_trees(train: DataFrame, features: Sequence[str], label: str = "demand",
                        max_depth: int = 8, step: float = 0.05, max_iter: int = 100,
                        subsample: float = 0.85, seed: int = 42, validation_col: str | None = None) -> PipelineModel:
    """L2: VectorAssembler + GBTRegressor; early stopping on a validation slice of train."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxDepth=max_depth, stepSize=step,
                       maxIter=max_iter, subsamplingRate=subsample, seed=seed)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[assemble(features), gbt]).fit(train)


def patient_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) at which a fit with patience ends up: the one of least loss before the
    loss has gone ``patience`` rounds without a gain, the earliest of equals; and whether those
    rounds are there. NaN is no gain; without any gain the first round is taken."""
    best, least = 1, float("inf")
    for i, loss in enumerate(losses, 1):
        if loss < least:
            best, least = i, loss
        elif i - best >= patience:
            return best, True
    return best, False


def train_with_patience(train: DataFrame, features: Sequence[str], validation_col: str, label: str = "demand",
                        patience: int = 50, max_iter: int = 2000, max_depth: int = 8, step: float = 0.05,
                        subsample: float = 0.85, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """L2 with patience: boosting ends after ``patience`` rounds without a gain on the validation
    slice, and the model is that of the best round. MLlib's own early stop is another rule (it
    ends at the first round whose gain is below a tolerance).

    A fit's first n trees do not depend on how many follow (each round has its own seed), so the
    fit is repeated with twice the rounds until the loss of each round shows the end: the work is
    at most twice that of the last fit, plus the fit of the best round. The rows are read many
    times and must come in one order: pass a checkpointed or stored table.

    Returns the model and a table (round, loss, is_chosen): mean squared error on the slice up to
    the last round fitted. Without validation rows, ``ValueError``."""
    ready = assemble(features)
    rows = ready.transform(train).select(label, validation_col, "features")
    held = rows.where(F.col(validation_col))
    if not held.limit(1).count():
        raise ValueError(f"no row of {validation_col}")
    seen = rows.where(~F.col(validation_col))

    def fit(n):
        return GBTRegressor(featuresCol="features", labelCol=label, maxDepth=max_depth, stepSize=step, maxIter=n,
                            subsamplingRate=subsample, seed=seed).fit(seen)

    n = min(max_iter, 2 * patience)
    while True:
        model = fit(n)
        losses = model.evaluateEachIteration(held, "squared")
        best, ended = patient_round(losses, patience)
        if ended or n >= max_iter:
            break
        n = min(max_iter, 2 * n)
    if best < n:
        model = fit(best)
    table = train.sparkSession.createDataFrame([(i, float(v), i == best) for i, v in enumerate(losses, 1)],
                                               "round int, loss double, is_chosen boolean")
    return PipelineModel(stages=[ready, model]), table


def select_two_stage(train: DataFrame, features: Sequence[str], label: str = "demand", corr_share: float = 0.7,
                     importance_share: float = 0.8, max_depth: int = 6, prelim_iter: int = 100,
                     validation_col: str | None = None) -> list[str]:
    """L2 feature selection (K2, then G9 on the preliminary model's importances). Features
    are ranked without the rows of the validation slice, on which the fits stop early.

    Both tables are one row per feature (tens of rows), so they are read back
    on the driver as plain lists.
    """
    from .rollup import corr_with_target, topk_by
    from .series import running_total_cut
    spark = train.sparkSession
    seen = train.where(~F.col(validation_col)) if validation_col else train
    corr = corr_with_target(seen, features, label).where(F.col("abs_corr").isNotNull())
    k = max(int(len(features) * corr_share), 1)
    top = [r["feature"] for r in topk_by(corr, "abs_corr", k).collect()]
    prelim = train_boosted_trees(train, top, label, max_depth=max_depth, max_iter=prelim_iter,
                                 validation_col=validation_col)
    imp = feature_importance(prelim, top, spark)
    keep = {r["feature"] for r in running_total_cut(imp, "importance", "feature", importance_share).collect()}
    return [f for f in top if f in keep] or top


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """L3: importance per feature (a table with one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def batch_score(model: PipelineModel, df: DataFrame, features: Sequence[str], keep=("city", "timestamp")) -> DataFrame:
    """L4: align features, predict, NaN -> 0."""
    from .clean import align_features
    aligned = align_features(df, features, keep=[k for k in keep if k in df.columns] +
                             (["demand"] if "demand" in df.columns else []))
    scored = model.transform(aligned.na.fill(0.0, subset=list(features)))
    return scored.withColumn("prediction", F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0))) \
                 .drop("features")


def baseline_regressors(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "demand",
                        seed: int = 42) -> DataFrame:
    """Linear, polynomial (degree 2) and random-forest regressors; long prediction table."""
    out = None
    models = {
        "linear": Pipeline(stages=[assemble(features), LinearRegression(featuresCol="features", labelCol=label)]),
        "polynomial": Pipeline(stages=[assemble(features, "raw"),
                                       PolynomialExpansion(degree=2, inputCol="raw", outputCol="features"),
                                       LinearRegression(featuresCol="features", labelCol=label)]),
        "random_forest": Pipeline(stages=[assemble(features), RandomForestRegressor(
            featuresCol="features", labelCol=label, numTrees=50, maxDepth=8, seed=seed)]),
    }
    for name, pipe in models.items():
        pred = pipe.fit(train).transform(test).select(F.lit(name).alias("model"), "city", "timestamp",
                                                      F.col(label).alias("actual"),
                                                      F.col("prediction").alias("predicted"))
        out = pred if out is None else out.unionByName(pred)
    return out


def kmeans_clusters(df: DataFrame, features: Sequence[str], k: int = 3, seed: int = KMEANS_SEED):
    """Drop nulls, standardise (population std), KMeans(k, seed)."""
    clean = df.na.drop(subset=list(features))
    std = standardize(clean, features, suffix="_z")
    zcols = [f"{c}_z" for c in features]
    model = Pipeline(stages=[assemble(zcols), KMeans(k=k, seed=seed, featuresCol="features",
                                                     predictionCol="cluster")]).fit(std)
    return model, model.transform(std), zcols


def pca_2d(scored: DataFrame, k: int = 2):
    """PCA on the standardised vectors; sign fixed so each component's largest |loading| is positive."""
    centred = scored  # standardised input: mean already 0
    pca = PCA(k=k, inputCol="features", outputCol="_pcs").fit(centred)
    pc = pca.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array(F.col("_pcs"))
    out = pca.transform(centred).withColumn("x", arr[0] * F.lit(signs[0])).withColumn("y", arr[1] * F.lit(signs[1]))
    return pca, out.drop("_pcs"), signs


def pc1_importance(pca, features: Sequence[str], spark) -> DataFrame:
    """|loading| of each feature on PC1 (named pc1_loading, T20)."""
    pc = pca.pc.toArray()
    return spark.createDataFrame([(f, float(abs(pc[i, 0]))) for i, f in enumerate(features)],
                                 "feature string, pc1_loading double")


def cluster_quality(df: DataFrame, features: Sequence[str], ks=range(2, 7), seed: int = KMEANS_SEED,
                    spark=None) -> DataFrame:
    """Within-cluster SSE and silhouette for each k."""
    clean = df.na.drop(subset=list(features))
    std = standardize(clean, features, suffix="_z")
    vec = assemble([f"{c}_z" for c in features]).transform(std).select("features").cache()
    rows = []
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
        rows.append((int(k), float(m.summary.trainingCost), float(ev.evaluate(m.transform(vec)))))
    vec.unpersist()
    return (spark or df.sparkSession).createDataFrame(rows, "k int, sse double, silhouette double")


def bisecting_clusters(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = KMEANS_SEED):
    """Top-down hierarchical clusters (BisectingKMeans)."""
    clean = df.na.drop(subset=list(features))
    std = standardize(clean, features, suffix="_z")
    model = Pipeline(stages=[assemble([f"{c}_z" for c in features]),
                             BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")]).fit(std)
    return model.transform(std)
