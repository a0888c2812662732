"""Exact quantiles without a buffer of values in any task.

A group's quantile is a rank; finding the value at a rank needs counts, not a sort of the
group in one place:

1. Values become rows (group, column, value). Groups of at most ``small`` rows go on whole.
2. Larger groups are narrowed: a mergeable sketch gives, for every wanted rank, a range of
   values that should hold it. If the largest group would still keep more than ``small``
   values, the sketch is drawn again with a finer resolution, and so on until it fits.
3. One aggregate with map-side combining counts the rows of every value inside a range and
   of every stretch between ranges. However many rows a hot group has, they are read and
   counted where they lie; only counts are shuffled, by value.
4. Running sums over these counts locate the ranks exactly. If a range turns out to miss
   its rank (a sketch errs within a bound), the ranges grow and step 3 runs again, so the
   result never depends on the sketch.

Between two ranks values are interpolated linearly, as ``percentile`` and
``quantile_cont`` do. NULLs do not count; NaN counts as the largest value; a group without
values has a NULL array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import typed_lit
from ..session import materialize
from .frames import _as_list, computed_once, join_null_safe

SMALL = 200_000             # rows of a group, or of its ranges, that one task may walk through
ACCURACY = 10_000           # first resolution of the sketch; the finest is FINEST
FINEST = 1_000_000
_COL, _VAL = "_c", "_v"


def _long(df: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(i).alias(_COL), F.col(c).cast("double").alias(_VAL)) for i, c in enumerate(cols)])
    return df.select(*keys, F.explode(values).alias("_s")).select(*keys, f"_s.{_COL}", f"_s.{_VAL}").where(f"{_VAL} IS NOT NULL")


def _ranges(long: DataFrame, group: list[str], probs: Sequence[float], small: int, accuracy: int, spread: float) -> DataFrame:
    """(group, _n, _b): rows and the ascending bounds lo, hi, lo, hi, ... of the ranges; no
    bounds where the group goes on whole."""
    grid = [min(1.0, max(0.0, p + s * spread / accuracy)) for p in sorted(set(probs)) for s in (-1, 1)]
    sketch = F.percentile_approx(_VAL, F.array(*[F.lit(x) for x in grid]), accuracy)
    table = long.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_b"))
    return materialize(table.withColumn("_b", F.when(F.col("_n") > small, F.col("_b"))))


def _picked(long: DataFrame, group: list[str], probs: Sequence[float], ranges: DataFrame | None) -> DataFrame:
    """(group, _q, _missed): the quantiles, and whether a rank fell outside the ranges."""
    if ranges is None:
        marked = long.withColumn("_r", F.lit(0))
    else:
        b, v = F.col("_b"), F.col(_VAL)
        pairs = F.sequence(F.lit(0), F.size(b) - 2, F.lit(2))
        inside = b.isNull() | F.exists(pairs, lambda i: (v >= F.get(b, i)) & (v <= F.get(b, i + 1)))
        # stretches are numbered by the bounds below them, so their order is that of the values
        below = F.when(b.isNull(), F.lit(0)).otherwise(F.size(F.filter(b, lambda x: x < v)))
        marked = join_null_safe(long, ranges.drop("_n"), group).select(
            *group, below.alias("_r"), F.when(inside, v).alias(_VAL))
    counted = marked.groupBy(*group, "_r", _VAL).agg(F.count(F.lit(1)).alias("_k"))
    here = Window.partitionBy(*group)
    upto = here.orderBy("_r", F.col(_VAL).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_k").over(upto)).withColumn("_rows", F.sum("_k").over(here))

    def at(rank: Column) -> Column:
        here_ = (F.col("_to") - F.col("_k") <= rank) & (rank < F.col("_to"))
        return F.max(F.when(here_, F.col(_VAL)))

    ranks = [F.lit(float(p)) * (F.col("_rows") - 1) for p in probs]
    found = placed.groupBy(*group).agg(F.max("_rows").alias("_rows"), *[
        at(f(r)).alias(f"_{name}{j}") for j, r in enumerate(ranks) for name, f in (("lo", F.floor), ("hi", F.ceil))])
    # between two equal values nothing is interpolated, so a quantile on a tie is the value itself
    values = [F.when((F.floor(r) == r) | (F.col(f"_lo{j}") == F.col(f"_hi{j}")), F.col(f"_lo{j}")).otherwise(
        (F.ceil(r) - r) * F.col(f"_lo{j}") + (r - F.floor(r)) * F.col(f"_hi{j}")) for j, r in enumerate(ranks)]
    missed = F.lit(False)
    for j in range(len(ranks)):
        missed = missed | F.col(f"_lo{j}").isNull() | F.col(f"_hi{j}").isNull()
    return found.select(*group, F.array(*values).alias("_q"), missed.alias("_missed"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by=None, small: int = SMALL,
              accuracy: int | None = None) -> DataFrame:
    """One row a group (one row in all without ``by``, none for an empty input): the keys and,
    for each column, an array of its quantiles. ``accuracy`` asks for the sketch's answer
    instead of the exact one. ``df`` is read several times; see :func:`attach_quantiles`."""
    keys, cols = _as_list(by), _as_list(cols)
    if accuracy is not None:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(*[F.percentile_approx(F.col(c).cast("double"), wanted, accuracy).alias(c) for c in cols])
    group = [*keys, _COL]
    long = _long(df, keys, cols)
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= small:
        out = _picked(long, group, probs, None)
    else:
        resolution, spread = ACCURACY, 2.0
        while True:
            fits = math.ceil(most * 2 * spread * len(set(probs)) / small)
            resolution = min(FINEST, max(resolution, fits))
            out = materialize(_picked(long, group, probs, _ranges(long, group, probs, small, resolution, spread)))
            if not out.where("_missed").limit(1).count():
                break
            spread *= 8
    held = [F.first(F.when(F.col(_COL) == i, F.col("_q")), ignorenulls=True).alias(c) for i, c in enumerate(cols)]
    return out.groupBy(*keys).agg(*held)


def quantile_lists(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list[float] | None]:
    """The quantiles of whole columns as Python lists; None for a column without values."""
    row = quantiles(computed_once(df), cols, probs, **kw).first()
    return {c: None if row is None else row[c] for c in _as_list(cols)}


def attach_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by=None, prefix: str = "_q_",
                     **kw) -> DataFrame:
    """``df`` with an array column ``prefix + column`` of quantiles: literals for whole columns,
    else joined on the group's keys (NULL keys are a group). A derived ``df`` is computed once."""
    base = computed_once(df)
    cols = _as_list(cols)
    table = quantiles(base, cols, probs, by, **kw)
    if not by:
        row = table.first()
        return base.select("*", *[typed_lit(None if row is None else row[c], table.schema[c].dataType).alias(prefix + c)
                                  for c in cols])
    return join_null_safe(base, table.withColumnsRenamed({c: prefix + c for c in cols}), _as_list(by), "left")
