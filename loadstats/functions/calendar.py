"""Date, math and string column expressions (all JVM-side, no UDFs)."""

from __future__ import annotations

import itertools
import re
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must match the reference's definitions.
# Season by month: 12, 1, 2 winter; 3, 4, 5 spring; 6, 7, 8 summer; others autumn.
SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8)}
SEASON_OTHER = "autumn"
# Cyclical periods: hour / 24, day / 31, month / 12, dayofweek / 7.
CYCLE_PERIODS = {"hour": 24, "day": 31, "month": 12, "dayofweek": 7}
# Day parts, hour ranges: [5, 12) morning, [12, 17) afternoon, [17, 22) evening, rest night.
DAY_PARTS = [(5, 12), (12, 17), (17, 22)]
# Fourier periods and harmonics.
FOURIER_PERIODS = (24, 168, 8760)
FOURIER_HARMONICS = (1, 2, 3)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dayofweek_mon0(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (Spark's ``weekday``)."""
    return F.weekday(col_(ts))


def calendar_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, day, month, year, quarter, dayofweek (Mon=0), dayofyear, ISO week."""
    t = F.col(ts)
    return df.select("*",
                     F.hour(t).alias("hour"), F.dayofmonth(t).alias("day"), F.month(t).alias("month"),
                     F.year(t).alias("year"), F.quarter(t).alias("quarter"),
                     dayofweek_mon0(t).alias("dayofweek"), F.dayofyear(t).alias("dayofyear"),
                     F.weekofyear(t).alias("weekofyear"))


def season(month) -> Column:
    """E2."""
    m = col_(month)
    expr = None
    for name, months in SEASON_MONTHS.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(SEASON_OTHER))


def cyclical(value, period: float, fn: str) -> Column:
    """Sin or cos of 2*pi*value/period."""
    arg = F.lit(2 * math.pi) * col_(value) / F.lit(float(period))
    return F.sin(arg) if fn == "sin" else F.cos(arg)


def cyclical_encode(df: DataFrame, parts: dict | None = None) -> DataFrame:
    parts = parts or CYCLE_PERIODS
    cols = []
    for name, period in parts.items():
        cols += [cyclical(name, period, "sin").alias(f"{name}_sin"),
                 cyclical(name, period, "cos").alias(f"{name}_cos")]
    return df.select("*", *cols)


def is_weekend(dayofweek) -> Column:
    """E4."""
    return (col_(dayofweek) >= 5).cast("int")


def day_part_onehot(hour) -> list[Column]:
    """E5: four 0/1 columns day_part_0..3."""
    h = col_(hour)
    out = [((h >= lo) & (h < hi)).cast("int").alias(f"day_part_{i}") for i, (lo, hi) in enumerate(DAY_PARTS)]
    out.append(((h >= DAY_PARTS[-1][1]) | (h < DAY_PARTS[0][0])).cast("int").alias("day_part_3"))
    return out


def fourier_terms(phase, periods=FOURIER_PERIODS, harmonics=FOURIER_HARMONICS) -> list[Column]:
    """sin/cos(2*pi*k*phase/P) for every period P and harmonic k."""
    p = col_(phase)
    out = []
    for period in periods:
        for k in harmonics:
            arg = F.lit(2 * math.pi * k) * p / F.lit(float(period))
            out += [F.sin(arg).alias(f"fourier_sin_{period}_{k}"), F.cos(arg).alias(f"fourier_cos_{period}_{k}")]
    return out


def truncate_date(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar date, ISO week and ISO week-year."""
    t = F.col(ts)
    return df.select("*", F.to_date(t).alias("date"), F.weekofyear(t).alias("week"),
                     F.expr(f"extract(YEAROFWEEK FROM `{ts}`)").alias("iso_year"))


def format_timestamp(ts, with_time: bool = True) -> Column:
    """E9."""
    return F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd")


def poly_terms(c: str) -> list[Column]:
    """Square and cube."""
    return [F.pow(F.col(c), 2).alias(f"{c}_squared"), F.pow(F.col(c), 3).alias(f"{c}_cubed")]


def pairwise_interactions(cols: Sequence[str], suffix: str = "_interaction",
                          name=lambda a, b: f"{a}_{b}") -> list[Column]:
    """Product for every unordered pair, in list order."""
    return [(F.col(a) * F.col(b)).alias(f"{name(a, b)}{suffix}") for a, b in itertools.combinations(cols, 2)]


def concat_key(cols: Sequence[str], sep: str = "_") -> Column:
    """Strata key, one text for each combination of values.

    A separator or backslash inside a value is written with a backslash before it and a
    NULL as ``\\N``, so no two combinations share a key."""
    def part(c):
        text = F.regexp_replace(F.col(c).cast("string"), f"([\\\\{re.escape(sep)}])", r"\\$1")
        return F.coalesce(text, F.lit("\\N"))
    return F.concat_ws(sep, *[part(c) for c in cols])


def clip(c, lo: float = -3.0, hi: float = 3.0) -> Column:
    """E13."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(c)))


def round_report(c, digits: int = 2) -> Column:
    """E14."""
    from .stats import round_half_away
    return round_half_away(col_(c), digits)


def canonical_city(c) -> Column:
    """Trim any whitespace, lower-case, whitespace runs to '_'."""
    stripped = F.regexp_replace(col_(c), r"^\s+|\s+$", "")
    return F.regexp_replace(F.lower(stripped), r"\s+", "_")


def parse_timestamp(df: DataFrame, candidates: Sequence[str] = ("local_time", "utc_time", "time",
                                                                 "timestamp", "date")) -> Column:
    """First candidate column present wins; epoch seconds for ``time``."""
    for name in candidates:
        if name in df.columns:
            dtype = dict(df.dtypes)[name]
            if name == "time" or dtype in ("bigint", "int", "double", "float"):
                return F.timestamp_seconds(F.col(name)).cast("timestamp_ntz")
            if dtype.startswith("timestamp") or dtype == "date":
                return F.col(name).cast("timestamp_ntz")
            return F.to_timestamp_ntz(F.col(name))
    raise ValueError(f"no time column among {list(candidates)}")
