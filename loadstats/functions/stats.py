"""Aggregate helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed_lit(v, data_type) -> Column:
    """``v`` as a literal of the given Spark type, NULL included."""
    if isinstance(v, (list, tuple)):
        return F.array(*[typed_lit(x, data_type.elementType) for x in v]).cast(data_type)
    if v is not None and data_type.typeName() == "timestamp_ntz":
        return F.lit(v.isoformat()).cast(data_type)
    return F.lit(v).cast(data_type)


def _one_row(df, aggs):
    one = df.agg(*aggs)
    return one.schema, one.first()


def scalars(df, aggs) -> dict:
    """Evaluate a one-row aggregate (a distributed job) and return its values."""
    return _one_row(df, aggs)[1].asDict()


def attach_scalars(df, aggs):
    """Global statistics as literals on every row, with the aggregates' own types.

    The aggregate runs once on the executors (partial + final); only its one
    result row reaches the driver, and it goes back into the plan as
    constants, so there is neither a cross join nor an unpartitioned window.
    """
    schema, row = _one_row(df, aggs)
    return df.select("*", *[typed_lit(row[f.name], f.dataType).alias(f.name) for f in schema.fields])


def round_half_away(c, digits: int = 2) -> Column:
    """Round on the binary value, half away from zero: rint(x * 10^d) / 10^d with
    exact ties moved away from zero (``x % 1.0`` is exact), i.e. C ``round``.

    ``F.round`` rounds the shortest decimal text of the double instead, which
    differs on values whose text ends in 5 but whose binary value does not.
    """
    x = F.col(c) if isinstance(c, str) else c
    p = float(10 ** digits)
    y = x * F.lit(p)
    frac = y % F.lit(1.0)
    r = F.when(F.abs(frac) == F.lit(0.5), y + F.signum(y) * F.lit(0.5)).otherwise(F.rint(y))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(r / F.lit(p))
