"""Per-series window features.

Every feature is evaluated per city in timestamp order. Bounded ROWS frames go
through :func:`frames.framed`, which partitions by (city, chunk) with halo rows,
so one large city never becomes one task. ``mode="calendar"`` lags by clock
time instead of rows (a hash join on ``(city, timestamp - n hours)``), which is
also correct across gaps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import fourier_terms
from ..functions.stats import attach_scalars
from .frames import (CHUNK, DEFAULT_BUCKET_SECONDS, DEFAULT_CHUNK_ROWS, POS, computed_once, framed, join_null_safe,
                     sliding, with_position)

# Fixed values from the reference feature set.
BASE_LAGS = (24, 48, 168)
ROLLING_WINDOWS = (24, 48, 168)
EWM_SPANS = (24, 168)
GRID_LAGS = tuple(range(1, 25)) + tuple(range(48, 169, 24))  # 1..24 plus 48..168 step 24 (30 lags)


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- lags, diffs, changes

def lag_features(df: DataFrame, lags: Sequence[int] = BASE_LAGS, col: str = "demand", by="city",
                 order: str = "timestamp", name="{col}_lag_{n}h", mode: str = "rows", **kw) -> DataFrame:
    """Value n rows (or n hours in calendar mode) earlier."""
    lags = sorted(set(int(n) for n in lags))
    if mode == "calendar":
        out = df
        for n in lags:
            prev = df.select(*_as_list(by), (F.col(order) + F.expr(f"INTERVAL {n} HOURS")).alias(order),
                             F.col(col).alias(name.format(col=col, n=n)))
            out = out.join(prev, _as_list(by) + [order], "left")
        return out
    return framed(df, lambda w: [F.lag(col, n).over(w).alias(name.format(col=col, n=n)) for n in lags],
                  by=by, order=order, back=max(lags), **kw)


def lag_grid(df: DataFrame, col: str = "demand", **kw) -> DataFrame:
    """30 distinct lags from one shared window (one sort)."""
    return lag_features(df, GRID_LAGS, col, name="{col}_lag_{n}", **kw)


# For windows below these many hours the grid has these steps.
LAG_STEPS = ((48, 6), (72, 12))


def lag_plan(n_rows: int, first: int = 24, window: int = 168, least: int = 24, steps=LAG_STEPS,
             widest: int = 24) -> list[int]:
    """G3 rule: lags from ``first`` over as much of ``window`` as ``n_rows`` leave room for
    (``least`` hours at any rate), finer where the window is short."""
    room = window if n_rows >= first + window else max(least, n_rows - first - least)
    step = next((s for below, s in sorted(steps) if room < below), widest)
    return list(range(first, first + room, step))


def lag_grid_adaptive(df: DataFrame, col: str = "demand", by="city", **kw) -> DataFrame:
    """One count of the shortest series (a one-row result) fixes the grid."""
    n = df.groupBy(*_as_list(by)).count().agg(F.min("count")).first()[0] or 0
    return lag_features(df, lag_plan(int(n)), col, by=by, name="{col}_lag_{n}", **kw)


def diff_features(df: DataFrame, ns: Sequence[int] = (24, 168), col: str = "demand",
                  names=("1d", "1w"), **kw) -> DataFrame:
    """X - x[t-n]."""
    return framed(df, lambda w: [(F.col(col) - F.lag(col, n).over(w)).alias(f"{col}_diff_{s}")
                                 for n, s in zip(ns, names)], back=max(ns), **kw)


def pct_change_expr(x: Column, base: Column) -> Column:
    """x/base - 1; zero base gives +-inf (0/0 gives 0), missing base gives 0."""
    ratio = F.when(base == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))))\
             .otherwise(x / base - 1)
    return F.coalesce(ratio, F.lit(0.0))


def pct_change_features(df: DataFrame, ns: Sequence[int] = (24, 168), col: str = "demand",
                        names=("1d", "1w"), **kw) -> DataFrame:
    """G8."""
    return framed(df, lambda w: [pct_change_expr(F.col(col), F.lag(col, n).over(w)).alias(f"{col}_pct_change_{s}")
                                 for n, s in zip(ns, names)], back=max(ns), **kw)


# ---------------------------------------------------------------- rolling

def rolling_stats(df: DataFrame, windows: Sequence[int] = ROLLING_WINDOWS, col: str = "demand",
                  stats: Sequence[str] = ("mean", "std", "min", "max"), **kw) -> DataFrame:
    """Statistics over the previous n rows (current row excluded), NULL until full."""
    names = {(n, s): f"{col}_rolling_{s}_{n}" for n in windows for s in stats}
    return sliding(df, col, names, shift=1, **kw)


def rolling_inclusive(df: DataFrame, n: int = 168, col: str = "demand", **kw) -> DataFrame:
    """Mean and std over the last n rows including the current one."""
    return sliding(df, col, {(n, s): f"{col}_rolling_{s}_incl_{n}" for s in ("mean", "std")}, shift=0, **kw)


def rolling_zscore(df: DataFrame, n: int = 24, col: str = "demand", **kw) -> DataFrame:
    """Z of the current value against the previous n rows."""
    z = sliding(df, col, {(n, "mean"): "_mu", (n, "std"): "_sd"}, shift=1, **kw)
    return z.withColumn(f"{col}_rolling_z_{n}", F.try_divide(F.col(col) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


# ---------------------------------------------------------------- exponentially weighted mean

# Largest exponent of a weight inside a chunk: e^600 ~ 4e260 leaves room for
# sums of thousands of rows with |x| up to ~1e40 before reaching the double limit.
_EXP_LIMIT = 600.0


def ewm_mean(df: DataFrame, span: int, col: str = "demand", out: str | None = None, by="city",
             order: str = "timestamp", shift: int = 1, positioned: bool = False,
             chunk_rows: int | None = None, **kw) -> DataFrame:
    """Adjusted EWM (alpha = 2/(span+1)) of the value ``shift`` rows back.

    y_t = sum_i b^(t-s-i) x_i / sum_i b^(t-s-i) over i <= t-s, b = 1-alpha. Inside a
    chunk, weights are b^-p (p = position in the chunk), so the sums are ordinary
    window sums; the chunk length keeps b^-p finite. What came before a chunk is
    carried through a table of one row a chunk: numerator and denominator as of the
    end of the last chunk that has values. Of the chunks before that one only the
    nearest with values counts, as the next is at least a whole chunk further away.
    A run of NULLs of any length therefore keeps the last mean.
    """
    alpha = 2.0 / (span + 1.0)
    lb = -math.log(1.0 - alpha)                 # ln(1/b)
    size = max(int(_EXP_LIMIT / lb), 1)
    if chunk_rows:                                # smaller chunks (very skewed series)
        # two chunks must span the e-folds after which a weight cannot change a double
        size = max(min(size, int(chunk_rows)), math.ceil(46.0 / lb))
    out = out or f"{col}_ewm_{span}"
    keys = _as_list(by)

    base = df if positioned else with_position(df, keys, order)
    base = base.withColumn(CHUNK, F.floor(F.col(POS) / F.lit(size)))
    p = F.col(POS) - F.col(CHUNK) * F.lit(size)
    wx = F.when(F.col(col).isNotNull(), F.exp(p * F.lit(lb)))
    end = F.lit(math.exp(-(size - 1) * lb))
    sums = base.groupBy(*keys, CHUNK).agg((F.sum(wx * F.col(col)) * end).alias("_n"), (F.sum(wx) * end).alias("_d"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("_d").isNotNull()
    sums = sums.withColumn("_prev", F.last(F.when(has, F.struct(CHUNK, "_n", "_d")), ignorenulls=True).over(before))
    fade = F.exp((F.col(f"_prev.{CHUNK}") - F.col(CHUNK)) * F.lit(size * lb))
    total = F.struct(F.col(CHUNK).alias("c"),
                     (F.col("_n") + F.coalesce(fade * F.col("_prev._n"), F.lit(0.0))).alias("n"),
                     (F.col("_d") + F.coalesce(fade * F.col("_prev._d"), F.lit(0.0))).alias("d"))
    carry = sums.select(*keys, CHUNK, F.last(F.when(has, total), ignorenulls=True).over(before).alias("_carry"))
    joined = join_null_safe(base, carry, [*keys, CHUNK], "left")
    upto = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    # weight of the carried sums where the chunk's first row weighs 1
    g = F.exp(((F.col("_carry.c") - F.col(CHUNK)) * F.lit(size) + F.lit(size - 1)) * F.lit(lb))
    sx, sw = F.sum(wx * F.col(col)).over(upto), F.sum(wx).over(upto)
    joined = joined.select(*base.columns, "_carry", g.alias("_g"), sx.alias("_sx"), sw.alias("_sw"))
    mean = F.when(F.col("_sw").isNull(), F.try_divide(F.col("_carry.n"), F.col("_carry.d"))).otherwise(
        F.try_divide(F.col("_sx") + F.coalesce(F.col("_g") * F.col("_carry.n"), F.lit(0.0)),
                     F.col("_sw") + F.coalesce(F.col("_g") * F.col("_carry.d"), F.lit(0.0))))
    res = joined.withColumn(out, mean).drop(CHUNK, "_carry", "_g", "_sx", "_sw")
    if shift > 0:
        res = framed(res.withColumnRenamed(out, "_now"), lambda w: [F.lag("_now", shift).over(w).alias(out)],
                     by=by, order=order, back=shift, positioned=True).drop("_now")
    return res if positioned else res.drop(POS)


# ---------------------------------------------------------------- sequences, tails, ranks

def sequence_windows(df: DataFrame, n: int = 24, col: str = "demand", **kw) -> DataFrame:
    """Array of the previous n values (only complete windows) and the current value as target."""
    def feats(w):
        frame = w.rowsBetween(-n, -1)
        return [F.collect_list(col).over(frame).alias("sequence")]
    out = framed(df, feats, back=n, **kw)
    return out.where(F.size("sequence") == n)


def tail_window(df: DataFrame, n: int = 168, by="city", order: str = "timestamp",
                bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Last n rows of each series.

    Rows are counted per (series, time bucket); running sums from the last bucket back tell
    which buckets belong to the tail whole. Only the bucket that the cut runs through is
    ranked, so no task sorts a series however large n is. NULL times come last in a tail."""
    keys = _as_list(by)
    base = computed_once(df).withColumn("_bkt", F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(bucket_seconds)))
    counts = base.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_k"))
    later = Window.partitionBy(*keys).orderBy(F.col("_bkt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("_left", F.lit(n) - F.coalesce(F.sum("_k").over(later), F.lit(0))).where("_left > 0")
    kept = join_null_safe(base, cut, [*keys, "_bkt"])
    last = Window.partitionBy(*keys, "_bkt").orderBy(F.col(order).desc())
    ranked = kept.where("_k > _left").withColumn("_rn", F.row_number().over(last)).where("_rn <= _left")
    return kept.where("_k <= _left").select(*df.columns).unionByName(ranked.select(*df.columns))


def top_n_per_group(df: DataFrame, n: int = 100, by="cluster", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """First n rows per group."""
    w = Window.partitionBy(*_as_list(by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def running_total_cut(df: DataFrame, value: str = "importance", name: str = "feature",
                      share: float = 0.8) -> DataFrame:
    """By value desc, keep rows until the running sum reaches ``share`` of the total.

    Meant for small per-feature tables (one row per feature).
    """
    w = Window.orderBy(F.col(value).desc(), F.col(name)).rowsBetween(Window.unboundedPreceding, 0)
    j = attach_scalars(df, [F.sum(value).alias("_tot")]).withColumn("cum", F.sum(value).over(w))
    return j.where(F.col("cum") - F.col(value) < F.lit(share) * F.col("_tot")).drop("_tot")


# ---------------------------------------------------------------- calendar-bound features

def holiday_neighbours(df: DataFrame, flag: str | None = "is_holiday", n: int = 24, **kw) -> DataFrame:
    """Holiday flag n rows ahead / behind, missing -> 0; all 0 without a flag column."""
    if flag is None or flag not in df.columns:
        return df.select("*", F.lit(0).alias("is_holiday"), F.lit(0).alias("is_day_before_holiday"),
                         F.lit(0).alias("is_day_after_holiday"))
    return framed(df, lambda w: [F.coalesce(F.lead(flag, n).over(w), F.lit(0)).alias("is_day_before_holiday"),
                                 F.coalesce(F.lag(flag, n).over(w), F.lit(0)).alias("is_day_after_holiday")],
                  back=n, ahead=n, **kw)


def fourier_features(df: DataFrame, by="city", order: str = "timestamp", mode: str = "rows") -> DataFrame:
    """phase = row position in the series (rows) or hours since series start (calendar)."""
    if mode == "calendar":
        start = df.groupBy(*_as_list(by)).agg(F.min(order).alias("_t0"))
        j = df.join(start, _as_list(by))
        phase = F.floor((F.unix_seconds(F.col(order).cast("timestamp")) -
                         F.unix_seconds(F.col("_t0").cast("timestamp"))) / F.lit(3600))
        return j.select(*df.columns, *fourier_terms(phase))
    p = with_position(df, by, order)
    return p.select(*df.columns, *fourier_terms(F.col(POS)))


# ---------------------------------------------------------------- documented baselines

def naive_previous_week(df: DataFrame, col: str = "demand", n: int = 168, **kw) -> DataFrame:
    """prediction = value n rows (one week of hours) earlier."""
    return framed(df, lambda w: [F.lag(col, n).over(w).alias("predicted")], back=n, **kw)


def historical_average(df: DataFrame, col: str = "demand", by="city", order: str = "timestamp",
                       chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Mean of earlier rows with the same hour and weekday.

    The rows of one (series, hour, weekday) are cut into chunks of positions. Sums and counts
    are taken a chunk, carried over the small chunk table, and run on inside the chunk, so
    no task holds a whole key."""
    key = [*_as_list(by), "_h", "_wd"]
    base = with_position(df.withColumn("_h", F.hour(order)).withColumn("_wd", F.weekday(order)), key, order)
    base = base.withColumn(CHUNK, F.floor(F.col(POS) / F.lit(max(int(chunk_rows), 1))))
    sums = base.groupBy(*key, CHUNK).agg(F.sum(col).alias("_s"), F.count(col).alias("_k"))
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*key, CHUNK, F.sum("_s").over(before).alias("_cs"), F.sum("_k").over(before).alias("_ck"))
    upto = Window.partitionBy(*key, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = F.try_divide(zero(F.col("_cs")) + zero(F.sum(col).over(upto)), zero(F.col("_ck")) + F.count(col).over(upto))
    return join_null_safe(base, carry, [*key, CHUNK], "left").select(*df.columns, mean.alias("predicted"))


def interpolate_linear(df: DataFrame, cols: Sequence[str], by="city", order: str = "timestamp",
                       limit: int = 3) -> DataFrame:
    """D3: time-linear interpolation across gaps of at most ``limit`` missing rows.

    Previous / next observed value, time and position come from one two-level
    carry scan (``frames.carry_both``) over helper columns.
    """
    from .frames import carry_both
    keys = _as_list(by)
    base = with_position(df, keys, order)
    t = F.unix_seconds(F.col(order).cast("timestamp")).cast("double")
    helpers = []
    for c in cols:
        base = base.withColumn(f"_v_{c}", F.col(c)) \
                   .withColumn(f"_t_{c}", F.when(F.col(c).isNotNull(), t)) \
                   .withColumn(f"_p_{c}", F.when(F.col(c).isNotNull(), F.col(POS)))
        helpers += [f"_v_{c}", f"_t_{c}", f"_p_{c}"]
    filled = carry_both(base, helpers, keys, positioned=True)
    out = filled
    for c in cols:
        pv, nv = F.col(f"_v_{c}_ffill"), F.col(f"_v_{c}_bfill")
        pt, nt = F.col(f"_t_{c}_ffill"), F.col(f"_t_{c}_bfill")
        gap = F.col(f"_p_{c}_bfill") - F.col(f"_p_{c}_ffill") - 1
        interp = pv + (nv - pv) * ((t - pt) / (nt - pt))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).when(gap <= limit, interp))
    return out.select(*df.columns)
