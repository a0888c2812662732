"""Registered queries backed by fitted models or randomised algorithms
(rows-only checks plus property tests): L2-L4, L10-L14, K3, N3, D7-D11."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import anomaly, clean, models, rollup, sample, series
from ..operators.features import forecast_features
from ..sources import fixtures as fx
from ..sources import bundle
from ..session import checkpoint_root, scratch_path
from .catalog_b import _stack_input
from .registry import query

# Round limits and depth of the final and the preliminary tree model, which
# stop early on the validation slice, and the rounds without gain that patience allows.
GBT_ITER = 2000
GBT_DEPTH = 8
PRELIM_ITER = 100
PATIENCE = 50
_FITTED: dict = {}   # (application, state of the input) -> fitted model, so the model-backed queries share one fit
CLUSTER_FEATURES = ["demand", "temperature", "humidity", "wind_speed"]


def _training_frame(spark, sf):
    """Features on the full history, chronological split, validation = last 10 % of train;
    infinities and gaps are filled with the medians of train."""
    h = fx.demand_hourly(spark, sf)
    feats, names = forecast_features(h)
    # Materialise the feature table into the shared checkpoint folder before
    # filtering: the iterative fit re-reads it many times, and a filter over
    # ~25 derived columns would make the optimizer's constraint inference explode.
    checkpoint_root(spark)
    data = clean.inf_to_null(feats.checkpoint(eager=True), names)
    split = sample.split_three_way(data, cuts=(0.7, 0.8))
    split = split.withColumn("is_validation", F.col("split") == "validation") \
                 .withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train")) \
                 .checkpoint(eager=True)
    train, test = clean.impute_train_median(split.where("split = 'train'"), split.where("split = 'test'"), names)
    return train.unionByName(test).checkpoint(eager=True), names


def _input_state(spark, sf):
    """Files, bytes and last change of the table that the model learns from: a table that is
    written anew at the same path is another input."""
    m = F.col("_metadata")
    row = fx.table(spark, sf, "events").select(m["file_path"].alias("p"), m["file_size"].alias("s"),
                                               m["file_modification_time"].alias("t")).distinct().agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.max("t").alias("t"),
        F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h")).first()
    return tuple(row)


def _fit(spark, sf):
    """L2, two stages: keep the top 70 % of features by |corr| with the target
    (on train), fit a preliminary model, keep the features that make up 80 % of
    its cumulated importance, fit the final model on those."""
    key = (spark.sparkContext.applicationId, sf, _input_state(spark, sf))
    if key not in _FITTED:
        data, names = _training_frame(spark, sf)
        train = data.where(F.col("split") == "train")
        selected = models.select_two_stage(train, names, "demand", max_depth=GBT_DEPTH, prelim_iter=PRELIM_ITER,
                                           validation_col="is_validation")
        model = models.train_boosted_trees(train, selected, max_depth=GBT_DEPTH, max_iter=GBT_ITER,
                                           validation_col="is_validation")
        _FITTED[key] = (model, data, selected)
    return _FITTED[key]


@query("L2_train_boosted_trees")
def l2(spark, sf):
    model, data, names = _fit(spark, sf)
    test = data.where(F.col("split") == "test")
    return model.transform(test).select("city", "timestamp", F.col("demand").alias("actual"),
                                        F.col("prediction").alias("predicted"))


@query("L2_boosting_rounds")
def l2_rounds(spark, sf):
    """Loss of every round on the validation slice, and the round that 50 rounds of patience choose."""
    _, data, names = _fit(spark, sf)
    train = data.where(F.col("split") == "train")
    return models.train_with_patience(train, names, "is_validation", max_iter=GBT_ITER, max_depth=GBT_DEPTH,
                                      patience=PATIENCE)[1]


@query("L3_feature_importance")
def l3(spark, sf):
    model, _, names = _fit(spark, sf)
    imp = models.feature_importance(model, names, spark)
    return imp.orderBy(F.col("importance").desc(), "feature")


@query("K3_topk_importance")
def k3(spark, sf):
    model, _, names = _fit(spark, sf)
    return rollup.topk_by(models.feature_importance(model, names, spark), "importance", 10)


@query("L4_batch_score")
def l4(spark, sf):
    model, data, names = _fit(spark, sf)
    return models.batch_score(model, data.where(F.col("split") == "test"), names)


@query("L10_forecast_run")
def l10(spark, sf):
    """Clamp the requested range, build features on full history, score, filter last, serve as
    each requested model (an unknown name is the ensemble, with the weights that L6 wrote),
    add bounds."""
    h = fx.demand_hourly(spark, sf)
    rng = clean.clamp_date_range(h, "2024-01-20", "2024-03-01").first()
    if not rng["overlaps"]:
        raise ValueError("requested range has no data")
    model, data, names = _fit(spark, sf)
    scored = models.batch_score(model, data, names)
    window = clean.filter_date_range(scored, rng["adjusted_start"], rng["adjusted_end"])
    preds = window.select("city", "timestamp", F.col("demand").alias("actual"), F.col("prediction").alias("predicted"))
    grid = models.weight_grid(_stack_input(spark, sf), "pa", "pb")
    path = bundle.write_weights(bundle.weights_table(grid, second_factor=models.SERVE_SECOND_FACTOR),
                                scratch_path(spark, "weights"))
    weights = spark.read.schema(bundle.WEIGHTS_SCHEMA).parquet(path)
    out = None
    for name in ("xgboost", "ensemble", "no such model"):
        one = bundle.served(preds, weights, name)
        table = models.forecast_table(one.drop("model"), bundle.chosen_model(name)).withColumn("requested", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


def _clusters(spark, sf):
    checkpoint_root(spark)
    md = fx.merged_daily(spark, sf).checkpoint(eager=True)
    model, scored, zcols = models.kmeans_clusters(md, CLUSTER_FEATURES, k=3)
    return model, scored, zcols


@query("L11_kmeans")
def l11(spark, sf):
    _, scored, _ = _clusters(spark, sf)
    return scored.select("city", "timestamp", "demand", "cluster")


@query("L12_pca_2d")
def l12(spark, sf):
    _, scored, _ = _clusters(spark, sf)
    pca, pts, _ = models.pca_2d(scored)
    ev = pca.explainedVariance.toArray()
    return pts.select("city", "timestamp", "cluster", "x", "y",
                      F.lit(float(ev[0])).alias("pc1_variance"), F.lit(float(ev[1])).alias("pc2_variance"),
                      F.lit(f"PC1 ({ev[0]:.2%} variance)").alias("x_label"),
                      F.lit(f"PC2 ({ev[1]:.2%} variance)").alias("y_label"))


@query("L13_pc1_importance")
def l13(spark, sf):
    _, scored, zcols = _clusters(spark, sf)
    pca, _, _ = models.pca_2d(scored)
    return models.pc1_importance(pca, CLUSTER_FEATURES, spark)


@query("L14_cluster_report")
def l14(spark, sf):
    """Per cluster: size, centre (scaled space) and its first 100 points (x, y, demand, timestamp)."""
    model, scored, _ = _clusters(spark, sf)
    _, pts, _ = models.pca_2d(scored)
    centers = model.stages[-1].clusterCenters()
    centre_rows = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)],
                                        "cluster int, center array<double>")
    sizes = pts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    top = series.top_n_per_group(pts.select("cluster", "x", "y", "demand", "timestamp", "city"), 100, "cluster",
                                 ("timestamp", "city"))
    # nested API shape: one row per cluster; the point list is capped at 100 by
    # the top-n above, so collecting it per cluster is bounded
    points = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "x", "y", "demand", cal.format_timestamp("timestamp").alias("timestamp")))).alias("points"))
    return sizes.join(centre_rows, "cluster").join(points, "cluster", "left") \
                .select("cluster", "size", "center", "points")


@query("N3_anomaly_isolation_forest")
def n3(spark, sf):
    md = fx.merged_daily(spark, sf)
    flagged = anomaly.anomaly_isolation_forest(md, fx.MERGED_NUMERIC, key=("city", "timestamp"))
    return flagged.select("city", "timestamp", "iso_score", "anomaly_iso")


@query("A15_anomaly_rate_three_flags")
def a15_three(spark, sf):
    """Rates of all three methods: z-score, IQR and isolation forest."""
    md = anomaly.anomaly_z_and_iqr(fx.merged_daily(spark, sf), fx.MERGED_NUMERIC)
    flagged = anomaly.anomaly_isolation_forest(md, fx.MERGED_NUMERIC, key=("city", "timestamp"))
    return rollup.anomaly_rate_by_city(flagged, ("anomaly_z", "anomaly_iqr", "anomaly_iso"))


@query("D7_baseline_regressors")
def d7(spark, sf):
    data, names = _training_frame(spark, sf)
    preds = models.baseline_regressors(data.where(F.col("split") == "train"), data.where(F.col("split") == "test"),
                                       names)
    return rollup.regression_metrics(preds, by="model")


@query("D8_cluster_quality")
def d8(spark, sf):
    return models.cluster_quality(fx.merged_daily(spark, sf), CLUSTER_FEATURES, range(2, 11))


@query("D9_hierarchical_clusters")
def d9(spark, sf):
    return models.bisecting_clusters(fx.merged_daily(spark, sf), CLUSTER_FEATURES, 4) \
                 .select("city", "timestamp", "demand", "cluster")


@query("D10_cluster_profile")
def d10(spark, sf):
    _, scored, _ = _clusters(spark, sf)
    s = scored.withColumn("season", cal.season(F.month("timestamp")))
    stats = s.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                     *[F.avg(c).alias(f"avg_{c}") for c in CLUSTER_FEATURES],
                                     *[F.stddev_samp(c).alias(f"std_{c}") for c in CLUSTER_FEATURES])
    by_season = s.groupBy("cluster").pivot("season", ["winter", "spring", "summer", "autumn"]).count()
    by_weekday = s.withColumn("wd", F.weekday("timestamp")).groupBy("cluster").pivot("wd", list(range(7))).count()
    by_weekday = by_weekday.select("cluster", *[F.col(str(i)).alias(f"weekday_{i}") for i in range(7)])
    by_hour = s.withColumn("h", F.hour("timestamp")).groupBy("cluster").pivot("h", list(range(24))).count()
    by_hour = by_hour.select("cluster", *[F.col(str(i)).alias(f"hour_{i}") for i in range(24)])
    return (stats.join(by_season, "cluster", "left").join(by_weekday, "cluster", "left")
                 .join(by_hour, "cluster", "left"))


def _numbered(df, h, order, bucket_rows=20_000):
    """Numbers the rows 0..n-1 (``_at``) in the order of ``h`` inside its buckets: a count
    for each bucket, running offsets, and a window over one bucket at a time."""
    buckets = max(1, -(-df.count() // bucket_rows))
    d = df.withColumn("_bkt", F.pmod(h, F.lit(buckets)))
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bkt").orderBy(h, *order)
    return (d.join(offsets, "_bkt").withColumn("_at", F.col("_off") + F.row_number().over(inside))
             .drop("_bkt", "_off"))


def _permuted(df, col, key, seed=7):
    """Shuffle one column over the whole table: rows and values are numbered in two
    different hash orders and meet at equal numbers."""
    hashed = lambda k: F.xxhash64(*[F.col(c).cast("string") for c in key], F.lit(k))
    rows = _numbered(df.drop(col), hashed(seed), key)
    vals = _numbered(df.select(*key, col), hashed(seed + 1), key).select("_at", col)
    return rows.join(vals, "_at").drop("_at")


@query("D11_permutation_importance")
def d11(spark, sf):
    model, data, names = _fit(spark, sf)
    test = data.where(F.col("split") == "test")          # a checkpointed table
    base = models.batch_score(model, test, names)
    base_mae = rollup.regression_metrics(base.withColumnRenamed("prediction", "predicted")
                                         .withColumnRenamed("demand", "actual")).first()["mae"]
    out = None
    for f in names:                                       # every feature the final model uses
        shuffled = _permuted(test, f, ["city", "timestamp"])
        scored = models.batch_score(model, shuffled, names)
        m = rollup.regression_metrics(scored.withColumnRenamed("prediction", "predicted")
                                      .withColumnRenamed("demand", "actual"))
        row = m.select(F.lit(f).alias("feature"), F.col("mae").alias("permuted_mae"),
                       (F.col("mae") - F.lit(base_mae)).alias("mae_increase"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.col("mae_increase").desc())
