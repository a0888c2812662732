"""Scaling and binning (F1-F8).

Statistics are computed with one aggregate (one row, or one row per group)
and broadcast back, so no unpartitioned window ever appears in a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import attach_scalars, scalars
from .frames import computed_once, join_null_safe
from .quantiles import attach_quantiles, quantiles

# Temperature bin edges used at serving time (right-closed).
FIXED_BIN_EDGES = [0, 40, 50, 60, 70, 80, 90, 100, 120]
# Quantile bins: five equal-frequency bins.
QUANTILE_BINS = 5


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def _stats(df: DataFrame, aggs, by=None) -> DataFrame:
    """Attach a statistics table: one row (broadcast) or one row per group."""
    if by:
        keys = _as_list(by)
        return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")
    return attach_scalars(df, aggs)


def minmax_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """Fitted min-max scaler (F2 'fit'): one aggregate, a dict of {c}_min / {c}_max."""
    return scalars(df, [F.min(c).alias(f"{c}_min") for c in cols] + [F.max(c).alias(f"{c}_max") for c in cols])


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled", by=None) -> DataFrame:
    """(x-min)/(max-min) over the whole table; a constant column gives NULL."""
    aggs = [F.min(c).alias(f"_mn_{c}") for c in cols] + [F.max(c).alias(f"_mx_{c}") for c in cols]
    j = _stats(df, aggs, by)
    out = [F.try_divide(F.col(c) - F.col(f"_mn_{c}"), F.col(f"_mx_{c}") - F.col(f"_mn_{c}")).alias(f"{c}{suffix}")
           for c in cols]
    return j.select(*df.columns, *out)


def minmax_transform(df: DataFrame, fitted: dict, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """F2 'transform': apply a fitted scaler; a constant column maps to 0."""
    j = df.select("*", *[F.lit(v).cast("double").alias(k) for k, v in fitted.items()])
    out = []
    for c in cols:
        rng = F.col(f"{c}_max") - F.col(f"{c}_min")
        out.append(((F.col(c) - F.col(f"{c}_min")) /
                    F.when(rng == 0, F.lit(1.0)).otherwise(rng)).alias(f"{c}{suffix}"))
    return j.select(*df.columns, *out)


def minmax_fit_transform(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """F2."""
    return minmax_transform(df, minmax_stats(df, cols), cols, suffix)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_std", by=None) -> DataFrame:
    """(x-mean)/population std; a constant column is divided by 1."""
    aggs = [F.avg(c).alias(f"_mu_{c}") for c in cols] + [F.stddev_pop(c).alias(f"_sd_{c}") for c in cols]
    j = _stats(df, aggs, by)
    out = []
    for c in cols:
        sd = F.col(f"_sd_{c}")
        out.append(((F.col(c) - F.col(f"_mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(f"{c}{suffix}"))
    return j.select(*df.columns, *out)


def inverse_scale(df: DataFrame, fitted: dict, pairs: dict[str, str]) -> DataFrame:
    """x*(max-min)+min; ``pairs`` maps scaled column -> source column of the fit."""
    j = df.select("*", *[F.lit(v).cast("double").alias(k) for k, v in fitted.items()])
    out = [(F.col(s) * (F.col(f"{src}_max") - F.col(f"{src}_min")) + F.col(f"{src}_min")).alias(f"{s}_inv")
           for s, src in pairs.items()]
    return j.select(*df.columns, *out)


def quantile_bin(df: DataFrame, cols: Sequence[str], q: int = QUANTILE_BINS, suffix: str = "_binned",
                 by=None, accuracy: int | None = None) -> DataFrame:
    """equal-frequency bins, duplicate edges dropped, right-closed, lowest included.

    code = (number of edges strictly below x) - 1, floored at 0.
    """
    probs = [i / q for i in range(q + 1)]
    j = attach_quantiles(df, cols, probs, by, prefix="_e_", accuracy=accuracy)
    out = []
    for c in cols:
        x = F.col(c)
        n_below = F.size(F.filter(F.array_distinct(F.col(f"_e_{c}")), lambda e: e < x))
        out.append(F.when(x.isNotNull(), F.greatest(n_below - 1, F.lit(0))).alias(f"{c}{suffix}"))
    return j.select(*df.columns, *out)


def fixed_bin(c: str, edges: Sequence[float] = FIXED_BIN_EDGES):
    """right-closed bins (e[i], e[i+1]] -> i; outside -> 0 (reference parity, T8)."""
    x = F.col(c)
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(float(i))) if expr is None else expr.when(cond, F.lit(float(i)))
    return expr.otherwise(F.lit(0.0))


def histogram(df: DataFrame, col: str, bins: int = 50, split=None) -> DataFrame:
    """equal-width bins between min and max; last bin closed on the right."""
    j = attach_scalars(df.where(F.col(col).isNotNull()), [F.min(col).alias("_lo"), F.max(col).alias("_hi")])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col(col) - F.col("_lo"), width))
    b = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")] + ([F.col(split).cast("int").alias(split)] if split else [])
    return (j.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"),
                  F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
             .select(*(["bin"] + ([split] if split else [])),
                     (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("bin_lo"),
                     (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("bin_hi"),
                     "n"))


def box_stats(df: DataFrame, cols: Sequence[str], by="city", accuracy: int | None = None) -> DataFrame:
    """F8: quartiles, IQR fences and whiskers (most extreme values inside the fences)."""
    keys = _as_list(by) if by else []
    long = computed_once(df).select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                         F.col(c).cast("double").alias("v")) for c in cols])).alias("s")) \
             .select(*keys, "s.column", "s.v").where(F.col("v").isNotNull())
    gk = keys + ["column"]
    q = long.groupBy(*gk).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
    found = quantiles(long, ["v"], [0.25, 0.5, 0.75], gk, accuracy=accuracy).withColumnRenamed("v", "_q")
    q = join_null_safe(q, found, gk)
    q = q.select(*gk, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
                 "min", "max", "n")
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = join_null_safe(long, q.select(*gk, "lo_fence", "hi_fence"), gk) \
                 .where((F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))) \
                 .groupBy(*gk).agg(F.min("v").alias("whisker_lo"), F.max("v").alias("whisker_hi"),
                                   F.count("v").alias("n_inside"))
    return join_null_safe(q, inside, gk, "left").select(
        *gk, "n", "min", "q1", "median", "q3", "max", "lo_fence", "hi_fence", "whisker_lo", "whisker_hi",
        (F.col("n") - F.coalesce(F.col("n_inside"), F.lit(0))).alias("n_outliers"))
