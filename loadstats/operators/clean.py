"""Projections, filters, joins and missing-value operators (P, J, M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import attach_scalars, round_half_away
from .frames import carry_backward, carry_forward
from .quantiles import attach_quantiles, quantile_lists

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


# ------------------------------------------------------------------ P: projections / filters

def project_rename_keep(df: DataFrame, keep: Sequence[str], rename: dict | None = None) -> DataFrame:
    """Keep the listed columns that exist, then rename."""
    out = df.select(*[c for c in keep if c in df.columns])
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def melt_wide_to_long(df: DataFrame, id_col: str = "timestamp", var: str = "city",
                      value: str = "demand") -> DataFrame:
    """One column per city -> (timestamp, city, demand)."""
    cols = [c for c in df.columns if c != id_col]
    return df.unpivot(id_col, cols, var, value)


def drop_null(df: DataFrame, cols=("demand",)) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL."""
    return df.na.drop("any", subset=list(cols))


def filter_date_range(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Inclusive on both ends, applied only when both bounds are given."""
    if start is None or end is None:
        return df
    t = F.col(ts)
    return df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz")))


def clamp_date_range(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """One row: requested range, data bounds, overlap flag and clipped range."""
    bounds = df.agg(F.min(ts).alias("data_start"), F.max(ts).alias("data_end"))
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    no_overlap = (e < F.col("data_start")) | (s > F.col("data_end"))
    return bounds.select(
        s.alias("requested_start"), e.alias("requested_end"), "data_start", "data_end",
        (~no_overlap).alias("overlaps"),
        F.when(~no_overlap, F.greatest(s, F.col("data_start"))).alias("adjusted_start"),
        F.when(~no_overlap, F.least(e, F.col("data_end"))).alias("adjusted_end"))


def filter_city(df: DataFrame, city: str | None, col: str = "city") -> DataFrame:
    """Filter when a city is given (the reference ignores it, T1)."""
    return df if city is None else df.where(F.col(col) == F.lit(city))


def mask_rows(df: DataFrame, flag: str) -> DataFrame:
    """Keep rows not flagged (NULL flag counts as not flagged)."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """P10: expected features in order; missing ones as 0.0; extras dropped."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep]
    cols += [F.col(c).cast("double").alias(c) if c in present else F.lit(0.0).alias(c) for c in expected]
    return df.select(*cols)


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-inf (and NaN) to NULL in floating columns."""
    cols = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    exprs = []
    for c in df.columns:
        if c in cols:
            x = F.col(c)
            exprs.append(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None)
                         .otherwise(x).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def select_by_dtype(df: DataFrame, kind: str = "numeric") -> list[str]:
    """Column names by type family."""
    if kind == "numeric":
        return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]
    if kind == "string":
        return [c for c, t in df.dtypes if t == "string"]
    if kind == "time":
        return [c for c, t in df.dtypes if t.startswith("timestamp") or t == "date"]
    raise ValueError(kind)


def find_time_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains date / time / dt."""
    return [c for c in df.columns if any(k in c.lower() for k in ("date", "time", "dt"))]


def parse_first_time_column(df: DataFrame, out: str = "parsed_time") -> DataFrame:
    """Parse the first time-like column (``try_to_timestamp`` leaves bad text NULL)."""
    cols = find_time_columns(df)
    if not cols:
        raise ValueError("no time-like column")
    c = cols[0]
    t = dict(df.dtypes)[c]
    expr = F.col(c).cast("timestamp_ntz") if t.startswith("timestamp") or t == "date" \
        else F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")
    return df.withColumn(out, expr)


def choose_features(df: DataFrame, default: Sequence[str], extra: Sequence[str] = (), requested: Sequence[str] = (),
                    enough: int = 3, wanted: int = 4, needed: Sequence[str] = ("demand",)) -> list[str]:
    """The columns to cluster on, by what ``df`` has.

    What is requested comes first (at least one has to exist), then the whole default set.
    Where that has gaps the ``needed`` columns must be there, and a set of fewer than
    ``enough`` is filled from ``extra`` up to ``wanted``."""
    def present(names):
        return [n for n in names if n in df.columns]

    if requested:
        if not present(requested):
            raise ValueError("none of the requested features exist")
        return present(requested)
    chosen = present(default)
    if len(chosen) == len(default):
        return chosen
    absent = [n for n in needed if n not in df.columns]
    if absent:
        raise ValueError(f"required features are missing: {absent}")
    if len(chosen) >= enough:
        return chosen
    return chosen + [n for n in present(extra) if n not in chosen][:wanted - len(chosen)]


# ------------------------------------------------------------------ J: joins and alignment

def join_demand_weather(demand: DataFrame, weather: DataFrame, keys=("city", "timestamp"),
                        unique: bool = False) -> DataFrame:
    """Inner equi-join; AQE chooses broadcast or sort-merge at run time.

    ``unique`` makes the job fail if a joined key occurs twice on either side. The check counts
    keys with a window over the join's own keys, so it rides on the two shuffles that the
    join needs anyway; there is no second pass."""
    if not unique:
        return demand.join(weather, list(keys), "inner")
    here = Window.partitionBy(*keys)
    sides = [df.withColumn(f"_n{i}", F.count(F.lit(1)).over(here)) for i, df in enumerate((demand, weather))]
    joined = sides[0].join(sides[1], list(keys), "inner")
    text = F.concat_ws(" ", F.lit("duplicate join key"), *[F.col(k).cast("string") for k in keys])
    twice = (F.col("_n0") > 1) | (F.col("_n1") > 1)
    return joined.where(F.when(twice, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_n0", "_n1")


def duplicate_report(left: DataFrame, right: DataFrame, keys=("city", "timestamp")) -> DataFrame:
    """(side, keys, count) of every key that occurs more than once on its side."""
    return duplicate_keys(left, keys).select(F.lit("left").alias("side"), *keys, "count").unionByName(
        duplicate_keys(right, keys).select(F.lit("right").alias("side"), *keys, "count"))


def duplicate_keys(df: DataFrame, keys=("city", "timestamp")) -> DataFrame:
    """J1 helper: keys that occur more than once."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def outer_compare(left: DataFrame, right: DataFrame, on: str, lcol: str, rcol: str) -> DataFrame:
    """Align two distributions on the value; missing side -> 0."""
    return (left.join(right, on, "full")
                .select(on, F.coalesce(F.col(lcol), F.lit(0.0)).alias(lcol),
                        F.coalesce(F.col(rcol), F.lit(0.0)).alias(rcol)))


def attach_scalar_stats(df: DataFrame, stats: Sequence[Column]) -> DataFrame:
    """One-row aggregate applied to every row as constants (no window, no cross join)."""
    return attach_scalars(df, stats)


def attach_group_stats(df: DataFrame, by, stats: Sequence[Column]) -> DataFrame:
    """Per-group aggregate joined back on the group key (AQE sizes the join)."""
    keys = _as_list(by)
    return df.join(df.groupBy(*keys).agg(*stats), keys, "left")


def attach_group_quantiles(df: DataFrame, by, named: dict[str, tuple[str, float]]) -> DataFrame:
    """J7 for quantiles: ``named`` maps an output column to (column, probability)."""
    out = df
    for name, (col, p) in named.items():
        out = attach_quantiles(out, [col], [p], by, prefix="_jq_").withColumn(name, F.get(f"_jq_{col}", F.lit(0))).drop(f"_jq_{col}")
    return out


# ------------------------------------------------------------------ M: missing values

def impute_group_median(df: DataFrame, cols: Sequence[str], by="city", accuracy: int | None = None) -> DataFrame:
    """M1: NULL -> median of the same group (all-NULL group stays NULL).

    ``accuracy=None`` is the exact median; an accuracy uses the mergeable sketch."""
    joined = attach_quantiles(df, cols, [0.5], by, prefix="_med_", accuracy=accuracy)
    return joined.select(*[F.coalesce(F.col(c), F.get(f"_med_{c}", F.lit(0))).alias(c) if c in cols else F.col(c)
                           for c in df.columns])


def ffill(df: DataFrame, cols: Sequence[str], by="city", order="timestamp", **kw) -> DataFrame:
    """M2."""
    return carry_forward(df, cols, by, order, **kw)


def bfill(df: DataFrame, cols: Sequence[str], by="city", order="timestamp", **kw) -> DataFrame:
    """M3."""
    return carry_backward(df, cols, by, order, **kw)


def impute_chain(df: DataFrame, cols: Sequence[str], by="city", order="timestamp",
                 accuracy: int | None = None) -> DataFrame:
    """M4: ffill, then bfill, then the global median."""
    from .frames import carry_both, computed_once
    df = computed_once(df)
    meds = quantile_lists(df, cols, [0.5], accuracy=accuracy)
    both = carry_both(df, cols, by, order)             # ffill and bfill from one two-level scan
    return both.select(*[F.coalesce(F.col(f"{c}_ffill"), F.col(f"{c}_bfill"), F.lit((meds[c] or [None])[0]).cast("double")).alias(c)
                         if c in cols else F.col(c) for c in df.columns])


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M5: NULL -> global mean."""
    joined = attach_scalar_stats(df, [F.avg(c).alias(f"_mean_{c}") for c in cols])
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_mean_{c}")).alias(c) if c in cols else F.col(c)
                           for c in df.columns])


def impute_train_median(train: DataFrame, other: DataFrame, cols: Sequence[str],
                        accuracy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M6: medians fitted on ``train`` applied to both frames."""
    found = quantile_lists(train, cols, [0.5], accuracy=accuracy)
    meds = {f"_tm_{c}": (found[c] or [None])[0] for c in cols}

    def apply(d):
        j = d.select("*", *[F.lit(v).cast("double").alias(k) for k, v in meds.items()])
        return j.select(*[F.coalesce(F.col(c), F.col(f"_tm_{c}")).alias(c) if c in cols else F.col(c)
                          for c in d.columns])
    return apply(train), apply(other)


def impute_zero(c, value=0) -> Column:
    """M7."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(value))


def missing_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """M8 / S10 core: per column null count and percentage, from one aggregate."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_null_{i}"))
        aggs.append(F.count(F.col(c)).alias(f"_nn_{i}"))
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                 F.col(f"_nn_{i}").alias("non_null"), F.col(f"_null_{i}").alias("null_count"))
        for i, c in enumerate(df.columns)]))
    out = one.select("_rows", stack.alias("s")).select(
        "s.column", "s.dtype", F.col("s.non_null").cast("bigint").alias("non_null"),
        F.col("s.null_count").cast("bigint").alias("null_count"),
        round_half_away(F.try_divide(F.col("s.null_count") * F.lit(100.0), F.col("_rows")), 2).alias("null_pct"))
    return out.where(F.col("null_count") > 0) if only_missing else out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Sequence", "Column",
                                                                   "DataFrame", "F", "T")]
