"""Stratified sampling, sample checks and chronological splits.

The sample is exact-size and reproducible: every row gets a uniform number from
``md5(key, seed)``; per stratum the ``quota`` rows with the smallest numbers are
kept. Quotas come from the (small) strata count table by largest remainder.
Only rows whose number is below a per-stratum rate (a few standard deviations
above the needed share) go through the ranking window, so a stratum holding a
third of the table never becomes one sorted task; strata left short by the
rate filter are re-run with rate 1, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import concat_key
from ..functions.stats import scalars
from .frames import POS, computed_once, join_null_safe, with_position
from .quantiles import quantiles

# A 5 % drift threshold, seed 42, 80/20 and 70/15/15 splits.
DRIFT_PCT = 5.0
SAMPLE_SEED = 42
TRAIN_SHARE = 0.8
SPLIT_3 = (0.70, 0.85)


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def row_hash(key: Sequence[str], seed: int = SAMPLE_SEED):
    """md5 of ``key|seed`` as hex text; its order defines the random order."""
    return F.md5(F.concat_ws("|", concat_key(key, "|"), F.lit(str(seed))))


def _uniform(h):
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(16.0 ** 15)


def strata_quotas(counts: DataFrame, n: int, total: int, stratum: str = "stratum") -> DataFrame:
    """Largest-remainder proportional allocation of exactly ``min(n, total)`` rows."""
    n = min(n, total)
    c = counts.withColumn("_base", F.floor(F.col("_cnt") * F.lit(n) / F.lit(total)).cast("bigint")) \
              .withColumn("_rem", (F.col("_cnt") * F.lit(n)) % F.lit(total))
    extra = int(scalars(c, [F.sum("_base").alias("_bt")])["_bt"] or 0)
    extra = n - extra                                   # units left after the floors (< number of strata)
    # the strata with the largest remainders get one more row: a top-k, which
    # Spark runs as per-partition top-k plus a merge (no global sort, no window)
    plus = c.orderBy(F.col("_rem").desc(), F.col(stratum)).limit(max(extra, 0)) \
            .select(stratum, F.lit(1).alias("_plus"))
    return c.join(plus, stratum, "left").select(
        stratum, "_cnt", (F.col("_base") + F.coalesce(F.col("_plus"), F.lit(0))).alias("quota"))


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: Sequence[str],
                      seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly min(n, rows) rows, proportional per stratum, without replacement."""
    keyed = df.withColumn("_stratum", concat_key(strata)).withColumn("_h", row_hash(key, seed))
    counts = keyed.groupBy(F.col("_stratum").alias("stratum")).agg(F.count(F.lit(1)).alias("_cnt"))
    total = counts.agg(F.sum("_cnt")).first()[0] or 0
    # The strata table has one row per stratum; it is small by construction
    # (the caller's strata rules keep it below the sample size).
    quotas = strata_quotas(counts, n, total).where(F.col("quota") > 0)
    quotas = quotas.withColumn("_rate", F.least(F.lit(1.0), (F.col("quota") + F.lit(6.0) * F.sqrt("quota") + 16)
                                                 / F.col("_cnt")))
    cand = keyed.join(quotas.withColumnRenamed("stratum", "_stratum"), "_stratum") \
                .withColumn("_u", _uniform(F.col("_h")))
    got = cand.where(F.col("_u") < F.col("_rate")).groupBy("_stratum", "quota") \
              .agg(F.count(F.lit(1)).alias("_got"))
    short = got.where(F.col("_got") < F.col("quota")).select("_stratum").union(
        quotas.withColumnRenamed("stratum", "_stratum").join(got, "_stratum", "left_anti").select("_stratum"))
    short_list = [r[0] for r in short.collect()]   # strata the rate filter left short (normally none)
    keep = F.col("_u") < F.col("_rate")
    if short_list:
        keep = keep | F.col("_stratum").isin(short_list)
    w = Window.partitionBy("_stratum").orderBy("_h", *key)
    return (cand.where(keep).withColumn("_rk", F.row_number().over(w))
                .where(F.col("_rk") <= F.col("quota"))
                .drop("_rk", "_u", "_h", "_rate", "_cnt", "quota", "_stratum"))


def narrowed_strata(strata: Sequence[str], n: int, anchor: str = "city", prefer: Sequence[str] = ("hour", "dayofweek"),
                    small: int = 20_000) -> list[str]:
    """A sample of fewer than ``small`` rows keeps two of three or more strata columns,
    the anchor and the first preferred one that is among them (else the second listed)."""
    if n >= small or len(strata) < 3 or anchor not in strata:
        return list(strata)
    return [anchor, next((c for c in prefer if c in strata), strata[1])]


def sample_with_fallback(df: DataFrame, strata: Sequence[str], n: int, key: Sequence[str],
                         seed: int = SAMPLE_SEED) -> DataFrame:
    """N7 + N8: reduce the strata, then fall back to city-only (or plain) sampling
    when the strata count reaches the sample size."""
    strata = narrowed_strata(strata, n)
    n_strata = df.select(*strata).distinct().count()
    if n_strata >= n:
        if "city" in df.columns:
            strata = ["city"]
        else:
            h = row_hash(key, seed)
            return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")
    return stratified_sample(df, strata, n, key, seed)


def _pct_diff(s, o):
    return F.when(o != 0, (s - o) / o * 100).otherwise(F.lit(0.0))


def sample_validation(full: DataFrame, sample: DataFrame, cols: Sequence[str],
                      accuracy: int | None = None) -> DataFrame:
    """Statistics of full vs sample per column with % differences.

    Both frames go into one long table tagged by origin; one grouped aggregate
    (by column) computes both sides, so there is no join at all.
    """
    def long(d, tag):
        arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
        return d.select(F.lit(tag).alias("_src"), F.explode(arr).alias("s")).select("_src", "s.column", "s.v")
    both = long(full, "o").unionByName(long(sample, "s"))
    both = computed_once(both)
    names = ["mean", "median", "std", "min", "max"]
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = []
    for tag, prefix in (("o", ""), ("s", "sample_")):
        v = F.when(F.col("_src") == tag, F.col("v"))
        aggs += [fns[m](v).alias(f"{prefix}{m}") for m in fns]
    found = quantiles(both, ["v"], [0.5], ["column", "_src"], accuracy=accuracy)
    medians = found.groupBy("column").agg(*[F.first(F.when(F.col("_src") == tag, F.get("v", F.lit(0))), ignorenulls=True)
                                            .alias(name) for tag, name in (("o", "median"), ("s", "sample_median"))])
    stats = join_null_safe(both.groupBy("column").agg(*aggs), medians, ["column"], "left")
    return stats.select("column", *names, *[f"sample_{m}" for m in names],
                        *[_pct_diff(F.col(f"sample_{m}"), F.col(m)).alias(f"{m}_diff_pct") for m in names])


def sample_drift_flags(validation: DataFrame, threshold: float = DRIFT_PCT) -> DataFrame:
    """Columns whose mean, median or std moved more than the threshold."""
    cond = (F.abs("mean_diff_pct") > threshold) | (F.abs("median_diff_pct") > threshold) | \
           (F.abs("std_diff_pct") > threshold)
    return validation.where(cond).select("column", "mean_diff_pct", "median_diff_pct", "std_diff_pct")


def distribution_compare(full: DataFrame, sample: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of each value in full vs sample, per strata column (missing -> 0)."""
    def shares(d, name):
        arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        long = d.select(F.explode(arr).alias("s")).select("s.column", "s.value")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
        tot = counts.groupBy("column").agg(F.sum("_n").alias("_t"))
        return counts.join(tot, "column").select("column", "value", (F.col("_n") / F.col("_t")).alias(name))
    j = shares(full, "full_share").join(shares(sample, "sample_share"), ["column", "value"], "full")
    return j.select("column", "value", F.coalesce("full_share", F.lit(0.0)).alias("full_share"),
                    F.coalesce("sample_share", F.lit(0.0)).alias("sample_share"))


def _series_sizes(df: DataFrame, by) -> DataFrame:
    return df.groupBy(*_as_list(by)).agg(F.count(F.lit(1)).alias("_n"))


def split_chronological(df: DataFrame, by="city", order: str = "timestamp",
                        train_share: float = TRAIN_SHARE) -> DataFrame:
    """First floor(n * share) rows of each series -> train, the rest -> test."""
    keys = _as_list(by)
    base = computed_once(df)                    # positions and sizes both read it
    p = join_null_safe(with_position(base, keys, order, materialize=False), _series_sizes(base, keys), keys)
    cut = F.floor(F.col("_n") * F.lit(train_share))
    return p.withColumn("split", F.when(F.col(POS) < cut, "train").otherwise("test")).drop(POS, "_n")


def split_three_way(df: DataFrame, by="city", order: str = "timestamp", cuts=SPLIT_3) -> DataFrame:
    """Chronological train / validation / test."""
    keys = _as_list(by)
    base = computed_once(df)
    p = join_null_safe(with_position(base, keys, order, materialize=False), _series_sizes(base, keys), keys)
    a = F.floor(F.col("_n") * F.lit(cuts[0]))
    b = F.floor(F.col("_n") * F.lit(cuts[1]))
    lab = F.when(F.col(POS) < a, "train").when(F.col(POS) < b, "validation").otherwise("test")
    return p.withColumn("split", lab).drop(POS, "_n")
