"""The wide feature table (P15): statistics are fitted on one frame, features built on any.

:func:`fit_wide` returns a flat dictionary of numbers (medians, ranges and bin edges of the
weather columns, mean and spread of the target, the cities), which a model bundle stores as
its scaler; :func:`wide_features` builds the same columns for training and for serving from
it. Rows are placed once; every windowed feature works on (city, chunk) with halo rows.

Features of a row use nothing of its own target (T4): differences, changes and the anomaly
flag are those of the row before. ``leaky=True`` gives them for the row itself.

Defined cases: without a weather, holiday or flag column its features are left out (weather)
or 0; weather gaps take the city's last, else next, else the fitted median value; a constant
weather column scales to 0; values beyond the fitted edges fall in the outer bins; a NULL or
unknown city has 0 in every city column; a row with too little history has NULLs; an empty
table gives an empty table. Columns of the input are kept unless a feature has their name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.stats import scalars
from ..session import materialize
from .frames import POS, carry_both, computed_once, framed, sliding, with_position
from .quantiles import quantile_lists
from .scale import QUANTILE_BINS, minmax_stats
from .series import ewm_mean, pct_change_expr

# Weather columns, lags in hours, labels of the two periods, score of an anomaly.
WEATHER = ("temperature", "humidity", "wind_speed", "precipitation", "cloud_cover")
FLAGS = ("anomaly_z", "anomaly_iqr", "anomaly_iso")
LAGS = (24, 48, 168)
PERIODS = {24: ("24h", "1d"), 168: ("7d", "1w")}
ROLLING = {24: ("mean", "std", "min", "max"), 168: ("mean", "std")}
ANOMALY_Z = 3.0
MOST_CITIES = 1000
_CITY = "city="


def _placed(df: DataFrame, by: str, order: str) -> DataFrame:
    """The rows with their position in the series, written once."""
    return materialize(with_position(computed_once(df), by, order, materialize=False))


def _filled(placed: DataFrame, weather: Sequence[str], medians: Mapping[str, float | None], by: str) -> DataFrame:
    """Weather gaps closed from the city's last, else next, value, else by the median."""
    if not weather:
        return placed
    both = carry_both(placed, weather, by, positioned=True)
    return both.select(*[F.coalesce(F.col(f"{c}_ffill"), F.col(f"{c}_bfill"), F.lit(medians.get(c))).cast("double").alias(c)
                         if c in weather else F.col(c) for c in placed.columns])


def _medians(df: DataFrame, weather: Sequence[str]) -> dict[str, float | None]:
    return {c: (v or [None])[0] for c, v in quantile_lists(df, weather, [0.5]).items()} if weather else {}


def _statistics(filled: DataFrame, col: str, weather: Sequence[str], medians: Mapping[str, float | None], by: str,
                cities: Sequence[str] | None, most_cities: int) -> dict[str, float | None]:
    out = {f"{c}_median": v for c, v in medians.items()}
    if weather:
        out |= minmax_stats(filled, weather)
        cuts = quantile_lists(filled, weather, [i / QUANTILE_BINS for i in range(QUANTILE_BINS + 1)])
        for c in weather:
            out |= {f"{c}_edge_{i}": e for i, e in enumerate(sorted(set(cuts[c] or [])))}
    out |= scalars(filled, [F.avg(col).alias("target_mean"), F.stddev_samp(col).alias("target_std")])
    if cities is None:
        found = filled.where(F.col(by).isNotNull()).select(F.col(by).cast("string")).distinct().limit(most_cities + 1).collect()
        if len(found) > most_cities:
            raise ValueError(f"more than {most_cities} values of {by}: name those that get a column of their own")
        cities = sorted(r[0] for r in found)
    return out | {_CITY + c: 1.0 for c in cities}


def fit_wide(df: DataFrame, col: str = "demand", weather: Sequence[str] = WEATHER, by: str = "city",
             order: str = "timestamp", cities: Sequence[str] | None = None,
             most_cities: int = MOST_CITIES) -> dict[str, float | None]:
    """The statistics of ``df`` that its wide features depend on, as one number a name.

    Exact quantiles and one aggregate; the values that reach the driver are a handful a
    weather column and one a city. With more than ``most_cities`` cities and no list of
    those wanted, ``ValueError``."""
    weather = [c for c in weather if c in df.columns]
    placed = _placed(df, by, order)
    medians = _medians(placed, weather)
    return _statistics(materialize(_filled(placed, weather, medians, by)), col, weather, medians, by, cities, most_cities)


def city_columns(fitted: Mapping[str, float | None]) -> dict[str, str]:
    """City -> name of its column: ``city_`` and the lower-cased letters and digits; where
    two cities would share one, the later carries its number."""
    out: dict[str, str] = {}
    for city in sorted(k[len(_CITY):] for k in fitted if k.startswith(_CITY)):
        name = "city_" + re.sub(r"\W+", "_", city.lower())
        out[city] = name if name not in out.values() else f"{name}_{len(out)}"
    return out


def _calendar(t: Column) -> dict[str, Column]:
    parts = {"hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t), "dayofweek": cal.dayofweek_mon0(t)}
    out = {f"{p}_{f}": cal.cyclical(parts[p], period, f) for p, period in cal.CYCLE_PERIODS.items() for f in ("sin", "cos")}
    out["is_weekend"] = cal.is_weekend(parts["dayofweek"])
    return out | {f"day_part_{i}": c for i, c in enumerate(cal.day_part_onehot(parts["hour"]))}


def _weather(fitted: Mapping[str, float | None], weather: Sequence[str]) -> dict[str, Column]:
    scaled = {}
    for c in weather:
        lo, hi = fitted[f"{c}_min"], fitted[f"{c}_max"]
        width = None if lo is None else (float(hi) - float(lo)) or 1.0
        scaled[c] = (F.col(c) - F.lit(lo).cast("double")) / F.lit(width).cast("double")
    out = {}
    for c, s in scaled.items():
        edges = [e for k, e in fitted.items() if re.fullmatch(re.escape(c) + r"_edge_\d+", k)]
        below = sum((F.when(F.lit(float(e)) < F.col(c), 1).otherwise(0) for e in edges), F.lit(0))
        code = F.least(F.greatest(below - 1, F.lit(0)), F.lit(max(len(edges) - 2, 0)))
        out |= {f"{c}_scaled": s, f"{c}_squared": s * s, f"{c}_cubed": s * s * s,
                f"{c}_binned": F.when(F.col(c).isNotNull(), code).cast("int")}
    return out | {f"{a}_{b}_interaction": scaled[a] * scaled[b] for a, b in itertools.combinations(weather, 2)}


def _history(w, col: str, leaky: bool, holiday: str | None) -> dict[str, Column]:
    """Features of single earlier (or, for holidays, later) rows."""
    at = lambda n: F.lag(col, n).over(w) if n else F.col(col)
    step, tail = (0, "") if leaky else (1, "_prev")
    out = {f"{col}_lag_{n}h": at(n) for n in LAGS}
    for n, (_, label) in PERIODS.items():
        out[f"{col}_diff_{label}{tail}"] = at(step) - at(step + n)
        out[f"{col}_pct_change_{label}{tail}"] = pct_change_expr(at(step), at(step + n))
    out[f"is_anomaly{tail}"] = F.coalesce(F.lag("_odd", step).over(w) if step else F.col("_odd"), F.lit(0))
    flag = F.coalesce(F.col(holiday).cast("int"), F.lit(0)) if holiday else F.lit(0)
    near = (lambda f: F.coalesce(f(flag, 24).over(w), F.lit(0))) if holiday else (lambda f: F.lit(0))
    return out | {"is_holiday": flag, "is_day_before_holiday": near(F.lead), "is_day_after_holiday": near(F.lag)}


def wide_features(df: DataFrame, fitted: Mapping[str, float | None] | None = None, col: str = "demand",
                  weather: Sequence[str] = WEATHER, by: str = "city", order: str = "timestamp",
                  holiday: str = "is_holiday", flags: Sequence[str] = FLAGS, leaky: bool = False,
                  cities: Sequence[str] | None = None, most_cities: int = MOST_CITIES) -> tuple[DataFrame, list[str]]:
    """``df`` with all features, and their names in order. ``fitted`` comes from
    :func:`fit_wide`; without it the statistics are those of ``df`` itself."""
    flags = [c for c in flags if c in df.columns]
    has_holiday = holiday if holiday in df.columns else None
    weather = [c for c in weather if c in df.columns and (fitted is None or f"{c}_min" in fitted)]
    placed = _placed(df, by, order)
    medians = _medians(placed, weather) if fitted is None else {c: fitted.get(f"{c}_median") for c in weather}
    rows = _filled(placed, weather, medians, by)
    if fitted is None:
        rows = materialize(rows)
        fitted = _statistics(rows, col, weather, medians, by, cities, most_cities)

    if flags:
        odd = F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags], F.lit(0))
    else:
        z = F.try_divide(F.abs(F.col(col) - F.lit(fitted["target_mean"]).cast("double")),
                         F.lit(fitted["target_std"]).cast("double"))
        odd = F.coalesce((z > ANOMALY_Z).cast("int"), F.lit(0))
    still = (_calendar(F.col(order)) | _weather(fitted, weather)
             | {name: F.coalesce((F.col(by).cast("string") == F.lit(city)).cast("int"), F.lit(0))
                for city, name in city_columns(fitted).items()})
    fourier = {f"fourier_{f}_{p}_{k}": cal.cyclical(F.col(POS) * F.lit(float(k)), p, f)
               for p in cal.FOURIER_PERIODS for k in cal.FOURIER_HARMONICS for f in ("sin", "cos")}
    rolling = {(n, s): f"{col}_rolling_{s}_{PERIODS[n][0]}" for n, stats in ROLLING.items() for s in stats}
    ewm = {n: f"{col}_ewm_{label}" for n, (label, _) in PERIODS.items()}
    told: dict[str, Column] = {}

    def feats(w):
        told.update(_history(w, col, leaky, has_holiday))
        return [c.alias(f"_f_{n}") for n, c in told.items()]

    rows = framed(rows.withColumn("_odd", odd), feats, by=by, order=order, back=max(LAGS) + 1, ahead=24, positioned=True)
    rows = sliding(rows, col, {k: f"_f_{n}" for k, n in rolling.items()}, by=by, order=order, positioned=True)
    for n, name in ewm.items():
        rows = ewm_mean(rows, n, col, f"_f_{name}", by=by, order=order, positioned=True)
    direct = still | fourier
    names = [*direct, *told, *rolling.values(), *ewm.values()]
    out = rows.select(*[c for c in df.columns if c not in names], *[direct[n].alias(n) if n in direct else
                                                              F.col(f"_f_{n}").alias(n) for n in names])
    return out, names


def complete_vectors(features: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """The rows whose features are all there (P16), with one vector of them in order."""
    from .models import assemble
    whole = features.na.drop(how="any", subset=list(names))
    return assemble(names, out).transform(whole)
