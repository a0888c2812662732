"""Aggregations, profiles, correlations, sorts and top-k.

Grouped statistics use hash aggregation with map-side partial aggregates;
global statistics produce one row. Pairwise correlations are one aggregate
with one ``corr`` per pair, so the table is scanned once.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import attach_scalars, round_half_away
from .frames import computed_once
from .quantiles import quantile_lists

# Fixed value: pairs with |r| at or above this (after rounding to 2) are "high".
HIGH_CORR = 0.7


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def daily_summary(df: DataFrame, ts="timestamp", value="demand", temp="temperature") -> DataFrame:
    """A1: by (city, date)."""
    return (df.groupBy("city", F.to_date(ts).alias("date"))
              .agg(F.avg(value).alias("avg_demand"), F.max(value).alias("max_demand"),
                   F.min(value).alias("min_demand"), F.avg(temp).alias("avg_temp")))


def weekly_summary(df: DataFrame, ts="timestamp", value="demand", temp="temperature",
                   with_year: bool = True) -> DataFrame:
    """A2: by (city, ISO year, ISO week); ``with_year=False`` is the reference's merged-week variant."""
    keys = [F.col("city")]
    if with_year:
        keys.append(F.expr(f"extract(YEAROFWEEK FROM `{ts}`)").alias("iso_year"))
    keys.append(F.weekofyear(ts).alias("week"))
    return df.groupBy(*keys).agg(F.avg(value).alias("avg_demand"), F.avg(temp).alias("avg_temp"))


def profile_by(df: DataFrame, part: str, ts="timestamp", value="demand", scale: int | None = None) -> DataFrame:
    """A3-A5: mean by hour of day, weekday (Mon=0) or month. With ``scale``, values of at most
    that many decimals are added as decimals, so the mean does not depend on row order."""
    fn = {"hour": F.hour, "dayofweek": F.weekday, "month": F.month}[part]
    mean = F.avg(value) if scale is None else F.try_divide(
        F.sum(F.col(value).cast(f"decimal(28,{scale})")).cast("double"), F.count(value))
    return df.groupBy(fn(ts).alias(part)).agg(mean.alias(f"avg_{value}"),
                                              F.count(value).alias("n"))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.explode(arr).alias("s")).select("s.column", "s.v")


def _quantile_lit(values, n: int) -> Column:
    return F.array(*[F.lit(None if values is None else values[i]).cast("double") for i in range(n)])


def describe(df: DataFrame, cols: Sequence[str], digits: int = 2, accuracy: int | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column: one aggregate beside the quartiles
    (exact, by rank selection, or from a sketch of the given ``accuracy``)."""
    df = computed_once(df)
    found = quantile_lists(df, cols, [0.25, 0.5, 0.75], accuracy=accuracy)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mu{i}"), F.stddev_samp(c).alias(f"sd{i}"),
                 F.min(c).cast("double").alias(f"lo{i}"), _quantile_lit(found[c], 3).alias(f"q{i}"),
                 F.max(c).cast("double").alias(f"hi{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                                        F.col(f"mu{i}").alias("mean"), F.col(f"sd{i}").alias("std"),
                                        F.col(f"lo{i}").alias("min"), F.col(f"q{i}").alias("q"),
                                        F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]))
    r = lambda c: round_half_away(c, digits)
    return one.select(rows.alias("s")).select(
        "s.column", F.col("s.count").cast("bigint").alias("count"), r(F.col("s.mean")).alias("mean"),
        r(F.col("s.std")).alias("std"), r(F.col("s.min")).alias("min"), r(F.col("s.q")[0]).alias("p25"),
        r(F.col("s.q")[1]).alias("p50"), r(F.col("s.q")[2]).alias("p75"), r(F.col("s.max")).alias("max"))


def sample_skewness(c) -> Column:
    """Bias-corrected G1 from Spark's population skewness."""
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population kurtosis."""
    n = F.count(c).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)


def extended_stats(df: DataFrame, cols: Sequence[str], digits: int = 2, accuracy: int | None = None) -> DataFrame:
    """Mean, median, std, skewness, kurtosis, min, max."""
    df = computed_once(df)
    found = quantile_lists(df, cols, [0.5], accuracy=accuracy)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"mu{i}"), _quantile_lit(found[c], 1)[0].alias(f"md{i}"), F.stddev_samp(c).alias(f"sd{i}"),
                 sample_skewness(c).alias(f"sk{i}"), sample_kurtosis(c).alias(f"ku{i}"),
                 F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
    one = df.agg(*aggs)
    names = ["mean", "median", "std", "skewness", "kurtosis", "min", "max"]
    keys = ["mu", "md", "sd", "sk", "ku", "lo", "hi"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                        *[round_half_away(F.col(f"{k}{i}").cast("double"), digits).alias(nm)
                                          for k, nm in zip(keys, names)]) for i, c in enumerate(cols)]))
    return one.select(rows.alias("s")).select("s.*")


def value_counts_top(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Per categorical column: distinct count and the k most frequent values (ties by value)."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(F.explode(arr).alias("s")).select("s.column", "s.value")
                .where(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(distinct, "column").select("column", "value", F.col("count").cast("bigint").alias("count"),
                                               F.col("rank").cast("int").alias("rank"),
                                               F.col("n_unique").cast("bigint").alias("n_unique"))


SKETCH_BITS = 14            # 2**14 registers: a standard error of about 0.8 %


def distinct_sketches(df: DataFrame, cols: Sequence[str], by: Column | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """A8 at scale: (part, column, n, sketch), a HyperLogLog sketch of every column's values for
    each part (a day, say). Sketches are some kilobytes whatever they counted, are kept as a
    table, and a new day's are added without reading the old days again."""
    part = F.lit(None).cast("string") if by is None else by
    wide = df.groupBy(part.alias("part")).agg(*[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"s{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch"))
                               for i, c in enumerate(cols)])).alias("r")
    return wide.select("part", rows).select("part", "r.*")


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """(column, n, n_unique): the distinct values over all parts of :func:`distinct_sketches`."""
    return sketches.groupBy("column").agg(F.sum("n").alias("n"),
                                          F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Normalised value counts, one-row total broadcast."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return attach_scalars(counts, [F.sum("n").alias("_t")]).select(
        col, (F.col("n") / F.col("_t")).alias("share"))


def group_argmax(df: DataFrame, by: str, value: str) -> DataFrame:
    """Group with the highest / lowest mean (ties -> smallest key)."""
    means = df.groupBy(by).agg(F.avg(value).alias("m")).where(F.col("m").isNotNull())
    return means.agg(F.min_by(by, F.struct(-F.col("m"), F.col(by))).alias(f"max_{value}_{by}"),
                     F.min_by(by, F.struct(F.col("m"), F.col(by))).alias(f"min_{value}_{by}"))


def dataset_profile(df: DataFrame, ts="timestamp", value="demand", temp="temperature",
                    season_col="season") -> DataFrame:
    """A10: one-row profile of the merged table.

    One grouped pass per city, then one aggregate over the (small) per-city
    table: global figures are recombined from per-city sums and counts.
    """
    per_city = df.groupBy("city").agg(
        F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), F.count(F.lit(1)).alias("_rows"),
        F.sum(value).alias("_sv"), F.count(value).alias("_nv"), F.min(value).alias("_mnv"),
        F.max(value).alias("_mxv"), F.sum(temp).alias("_st"), F.count(temp).alias("_nt"),
        F.collect_set(season_col).alias("_seasons"))
    mv = F.col("_sv") / F.col("_nv")
    mt = F.col("_st") / F.col("_nt")
    return per_city.agg(
        F.date_format(F.min("_t0"), "yyyy-MM-dd").alias("data_start_date"),
        F.date_format(F.max("_t1"), "yyyy-MM-dd").alias("data_end_date"),
        F.sum("_rows").alias("total_records"),
        F.sort_array(F.collect_list("city")).alias("cities"),
        (F.sum("_sv") / F.sum("_nv")).alias("avg_demand"), F.min("_mnv").alias("min_demand"),
        F.max("_mxv").alias("max_demand"), (F.sum("_st") / F.sum("_nt")).alias("avg_temperature"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_seasons")))).alias("seasons"),
        F.min_by("city", F.struct(-mv, F.col("city"))).alias("highest_demand_city"),
        F.min_by("city", F.struct(mv, F.col("city"))).alias("lowest_demand_city"),
        F.min_by("city", F.struct(-mt, F.col("city"))).alias("hottest_city"),
        F.min_by("city", F.struct(mt, F.col("city"))).alias("coldest_city"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson r as covariance / (std * std), all population moments, in one pass.

    Every moment is taken over the rows where both columns are set. Built-in
    ``corr`` divides by the spread and raises under ANSI mode when a column is
    constant; here the division is ``try_divide``, so r is NULL."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


FEW_COLUMNS = 12


def gram_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy): for every two columns i < j the count and the sums over
    the rows where both are set.

    Each task multiplies its batches' columns as matrices and emits one row a pair; these rows
    are mergeable, so they are summed by pair. Values are taken from the columns' means, found
    by one aggregate before, so the square sums do not cancel."""
    cols = list(cols)
    df = computed_once(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]))
    means = df.agg(*[F.avg(c).alias(c) for c in df.columns]).first()
    origin = [m or 0.0 for m in means]
    k = len(cols)

    def multiplied(batches):
        import numpy as np
        import pyarrow as pa
        sums = np.zeros((4, k, k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            held = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float64)
            x = np.where(held > 0, x - np.array(origin), 0.0)
            sums += np.stack([held.T @ held, x.T @ held, (x * x).T @ held, x.T @ x])
        n, s, ss, xy = sums
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_pydict({
            "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "sx": s[i, j], "sy": s[j, i],
            "sxx": ss[i, j], "syy": ss[j, i], "sxy": xy[i, j]})

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = df.mapInArrow(multiplied, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def corr_of_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every two columns (a before b in the list), from the Gram table; NULL where
    one of them is constant over the rows that both have."""
    names = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    var = lambda ss, s: F.greatest(F.col(ss) / n - F.pow(F.col(s) / n, F.lit(2.0)), F.lit(0.0))
    # a spread below the rounding error of its own sums is that of a constant
    spread = lambda ss, s: F.when(var(ss, s) > F.lit(1e-14) * F.col(ss) / n, F.sqrt(var(ss, s)))
    cov = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    r = F.when(n > 0, F.try_divide(cov, spread("sxx", "sx") * spread("syy", "sy")))
    return gram_table(df, cols).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))


def corr_pairs(df: DataFrame, cols: Sequence[str], ordered: bool = True, few: int = FEW_COLUMNS) -> DataFrame:
    """Pearson r for every pair; long (a, b, r). Up to ``few`` columns from one aggregate
    with an expression a pair, more from the Gram table."""
    if len(cols) > few:
        half = corr_of_many(df, cols)
        if not ordered:
            return half
        names = F.explode(F.array(*[F.lit(c) for c in cols]))
        same = df.sparkSession.range(1).select(names.alias("a")).select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
        return half.select(F.explode(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")))
                           .alias("s")).select("s.a", "s.b", "s.r").unionByName(same)
    pairs = list(itertools.combinations(cols, 2))
    one = df.agg(*[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")))
        if ordered:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")))
    if ordered:
        entries += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in cols]
    return one.select(F.explode(F.array(*entries)).alias("s")).select("s.a", "s.b", "s.r")


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """A12, rounded."""
    return corr_pairs(df, cols).select("a", "b", round_half_away("r", digits).alias("r"))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = HIGH_CORR) -> DataFrame:
    """Unordered pairs (list order) with |round(r, 2)| >= threshold, strongest first."""
    r = corr_pairs(df, cols, ordered=False).select("a", "b", round_half_away("r", 2).alias("r"))
    return r.where(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "a", "b")


def corr_with_target(df: DataFrame, features: Sequence[str], target: str = "demand") -> DataFrame:
    """|r| of each feature with the target, ranked (ties by name)."""
    one = df.agg(*[safe_corr(f, target).alias(f"r{i}") for i, f in enumerate(features)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"r{i}")).alias("abs_corr"))
                                          for i, f in enumerate(features)])).alias("s")).select("s.*")
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    return long.withColumn("rank", F.row_number().over(w))


def anomaly_rate_by_city(df: DataFrame, flags: Sequence[str] = ("anomaly_z", "anomaly_iqr"),
                         value: str = "demand", by: str = "city") -> DataFrame:
    """Per group count, flag sums and percentages."""
    short = {f: f.replace("anomaly_", "") for f in flags}
    aggs = [F.count(value).alias("total_records")]
    aggs += [F.count_if(F.col(f)).alias(f"{short[f]}_anomalies") for f in flags]
    out = df.groupBy(by).agg(*aggs)
    return out.select("*", *[F.try_divide(F.col(f"{short[f]}_anomalies") * F.lit(100.0), F.col("total_records"))
                             .alias(f"{short[f]}_pct") for f in flags])


def cleaning_report(df: DataFrame, flag: str = "anomaly_iqr") -> DataFrame:
    """Rows before / after removing flagged rows."""
    r = df.agg(F.count(F.lit(1)).alias("rows_before"),
               F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("rows_after"))
    return r.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
                    round_half_away(F.try_divide((F.col("rows_before") - F.col("rows_after")) * F.lit(100.0),
                                                 F.col("rows_before")), 2).alias("pct_removed"))


# Fixed value: MAPE guards the denominator with double machine epsilon.
MAPE_EPS = 2.220446049250313e-16


def metric_aggs(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """MAE, RMSE, MAPE (%), R^2 as plain aggregates."""
    e = F.col(actual) - F.col(predicted)
    y = F.col(actual)
    sse = F.sum(e * e)
    sst = F.count(y) * F.var_pop(y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(MAPE_EPS))) * 100).alias("mape"),
            (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"), F.count(y).alias("n")]


def regression_metrics(df: DataFrame, actual="actual", predicted="predicted", by=None) -> DataFrame:
    """Metrics overall or per model."""
    valid = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    if by:
        return valid.groupBy(*_as_list(by)).agg(*metric_aggs(actual, predicted))
    return valid.agg(*metric_aggs(actual, predicted))


def best_model(metrics: DataFrame, by: str = "model", metric: str = "mae") -> DataFrame:
    """Arg-min of the metric (ties by name)."""
    return metrics.agg(F.min_by(by, F.struct(F.col(metric), F.col(by))).alias("best_model"),
                       F.min(metric).alias(f"best_{metric}"))


def sort_city_time(df: DataFrame) -> DataFrame:
    """K1."""
    return df.orderBy("city", "timestamp")


def topk_by(df: DataFrame, value: str, k: int, name: str = "feature") -> DataFrame:
    """K2 / K3: top k rows by value (ties by name) -> TakeOrderedAndProject."""
    return df.orderBy(F.col(value).desc(), F.col(name)).limit(k)


def first_groups(df: DataFrame, k: int = 3, col: str = "city") -> DataFrame:
    """K4: the first k distinct keys."""
    return df.select(col).distinct().orderBy(col).limit(k)
