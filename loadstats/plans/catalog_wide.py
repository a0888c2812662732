"""Registered queries over the wide feature table (P15): the table itself, the vectors of its
complete rows, and the same columns served from stored statistics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import sample, wide
from ..functions.stats import round_half_away
from ..operators.scale import QUANTILE_BINS
from ..sources import fixtures as fx
from .registry import query

VIEW = "region_weather_gaps"
W4 = fx.WEATHER_COLS
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
# The holidays of the registered queries, month and day.
HOLIDAYS = ("01-01", "05-01", "12-25")
SERIES = "PARTITION BY city ORDER BY timestamp"


def _input(spark, sf):
    day = F.date_format("timestamp", "MM-dd")
    return fx.region_weather_gaps(spark, sf).withColumn("is_holiday", day.isin(*HOLIDAYS).cast("int"))


def _columns_sql() -> dict[str, str]:
    """Feature -> SQL over ``z`` (rows with filled weather and scaled values), in order."""
    out = {}
    parts = {"hour": "hour(timestamp)", "day": "day(timestamp)", "month": "month(timestamp)",
             "dayofweek": "(isodow(timestamp) - 1)"}
    for part, period in cal.CYCLE_PERIODS.items():
        for f in ("sin", "cos"):
            out[f"{part}_{f}"] = f"{f}(2 * pi() * {parts[part]} / {float(period)})"
    out["is_weekend"] = "CAST(isodow(timestamp) >= 6 AS INTEGER)"
    for i, (lo, hi) in enumerate(cal.DAY_PARTS):
        out[f"day_part_{i}"] = f"CAST(hour(timestamp) >= {lo} AND hour(timestamp) < {hi} AS INTEGER)"
    out["day_part_3"] = f"CAST(hour(timestamp) >= {cal.DAY_PARTS[-1][1]} OR hour(timestamp) < {cal.DAY_PARTS[0][0]} AS INTEGER)"
    for c in W4:
        out |= {f"{c}_scaled": f"s_{c}", f"{c}_squared": f"s_{c} ** 2", f"{c}_cubed": f"s_{c} ** 3", f"{c}_binned": f"b_{c}"}
    for i, a in enumerate(W4):
        out |= {f"{a}_{b}_interaction": f"s_{a} * s_{b}" for b in W4[i + 1:]}
    for r in REGIONS:
        out["city_" + r.lower().replace(" ", "_")] = f"CAST(city = '{r}' AS INTEGER)"
    for p in cal.FOURIER_PERIODS:
        for k in cal.FOURIER_HARMONICS:
            out |= {f"fourier_{f}_{p}_{k}": f"{f}(2 * pi() * {k} * (rn - 1) / {float(p)})" for f in ("sin", "cos")}
    out |= {f"demand_lag_{n}h": f"lag(demand, {n}) OVER w" for n in wide.LAGS}
    for n, (_, label) in wide.PERIODS.items():
        now, then = "lag(demand, 1) OVER w", f"lag(demand, {n + 1}) OVER w"
        out[f"demand_diff_{label}_prev"] = f"{now} - {then}"
        out[f"demand_pct_change_{label}_prev"] = f"coalesce({now} / nullif({then}, 0) - 1, CAST(0 AS DOUBLE))"
    out["is_anomaly_prev"] = f"coalesce(CAST(lag(abs(demand - mu) / sd) OVER w > {wide.ANOMALY_Z} AS INTEGER), 0)"
    out["is_holiday"] = "is_holiday"
    out["is_day_before_holiday"] = "coalesce(lead(is_holiday, 24) OVER w, 0)"
    out["is_day_after_holiday"] = "coalesce(lag(is_holiday, 24) OVER w, 0)"
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    for n, stats in wide.ROLLING.items():
        frame = f"OVER ({SERIES} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out |= {f"demand_rolling_{s}_{wide.PERIODS[n][0]}":
                f"CASE WHEN count(demand) {frame} = {n} THEN {fn[s]}(demand) {frame} END" for s in stats}
    for n, (label, _) in wide.PERIODS.items():
        b, frame = 1.0 - 2.0 / (n + 1.0), f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out[f"demand_ewm_{label}"] = f"sum(power({b!r}, -rn) * demand) {frame} / sum(power({b!r}, -rn)) {frame}"
    return out


WHOLE = {"is_weekend", "is_holiday", "is_day_before_holiday", "is_day_after_holiday", "is_anomaly_prev",
         *[f"day_part_{i}" for i in range(4)], *[f"{c}_binned" for c in W4],
         *["city_" + r.lower().replace(" ", "_") for r in REGIONS]}


ROOTS = ("demand_rolling_std_", "demand_ewm_")


def _digits(name: str) -> int:
    """Spreads and weighted means of money are shown to a tenth of a cent: at twelve figures the
    last ones depend on the order of addition. (Plain means cannot lie on a six-digit tie.)"""
    return 3 if name.startswith(ROOTS) else 6


def _wide_sql(fitted_on: str = "TRUE") -> str:
    """The whole table; its statistics come from the rows where ``fitted_on`` holds."""
    upto = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    onward = f"OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    med = ", ".join(f"median({c}) AS med_{c}" for c in W4)

    def filled(rows, medians):
        cols = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) {upto}, first_value({c} IGNORE NULLS) {onward}, med_{c}) AS {c}"
                         for c in W4)
        return f"SELECT city, timestamp, demand, {cols}, rn FROM {rows}, {medians}"
    probs = [i / QUANTILE_BINS for i in range(QUANTILE_BINS + 1)]
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, list_sort(list_distinct(quantile_cont({c}, {probs}))) AS e_{c}"
                      for c in W4)
    scaled = ", ".join(
        f"({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END AS s_{c}, "
        f"CAST(least(greatest(len(list_filter(e_{c}, lambda e: e < {c})) - 1, 0), greatest(len(e_{c}) - 2, 0)) AS INTEGER) AS b_{c}"
        for c in W4)
    days = ", ".join(f"'{d}'" for d in HOLIDAYS)
    cols = ", ".join(f'{e if n in WHOLE else f"(round({e}, {_digits(n)}) + 0.0)"} AS "{n}"' for n, e in _columns_sql().items())
    return (f"WITH numbered AS (SELECT *, row_number() OVER ({SERIES}) AS rn, count(*) OVER (PARTITION BY city) AS cnt FROM {VIEW}), "
            f"learned AS (SELECT * FROM numbered WHERE {fitted_on}), med AS (SELECT {med} FROM learned), "
            f"seen AS ({filled('learned', 'med')}), "
            f"stats AS (SELECT {stats}, avg(demand) AS mu, stddev_samp(demand) AS sd FROM seen), "
            f"f AS ({filled('numbered', 'med')}), "
            f"z AS (SELECT *, {scaled}, CAST(strftime(timestamp, '%m-%d') IN ({days}) AS INTEGER) AS is_holiday FROM f, stats) "
            f"SELECT city, timestamp, demand, {cols} FROM z WINDOW w AS ({SERIES})")


def _vectors_sql() -> str:
    names = list(_columns_sql())
    body = _wide_sql()
    some = " AND ".join(f'"{n}" IS NOT NULL' for n in names)
    array = ", ".join(f'CAST("{n}" AS DOUBLE)' for n in names)
    return f"SELECT city, timestamp, [{array}] AS features FROM ({body}) WHERE {some}"


def _rounded(c, name: str):
    return c if name in WHOLE else round_half_away(c, _digits(name)) + F.lit(0.0)


def _shown(df, names):
    return df.select("city", "timestamp", "demand", *[_rounded(F.col(n), n).alias(n) for n in names])


@query("P15_wide_features", _wide_sql(), (VIEW,))
def wide_table(spark, sf):
    return _shown(*wide.wide_features(_input(spark, sf), weather=W4))


@query("P15_assemble_features", _vectors_sql(), (VIEW,))
def p15(spark, sf):
    """One vector a complete row, its components rounded as the SQL's."""
    table, names = wide.wide_features(_input(spark, sf), weather=W4)
    rows = wide.complete_vectors(table, names)
    rows = rows.withColumn("features", vector_to_array("features"))
    return rows.select("city", "timestamp", F.array(*[_rounded(F.col("features")[i], n) for i, n in enumerate(names)]).alias("features"))


@query("P15_served_features", _wide_sql(f"rn - 1 < floor(cnt * {sample.TRAIN_SHARE})"), (VIEW,))
def served(spark, sf):
    """Statistics of the train slice alone, features of all rows."""
    rows = fx.materialize(_input(spark, sf))
    train = sample.split_chronological(rows).where("split = 'train'").drop("split")
    return _shown(*wide.wide_features(rows, wide.fit_wide(train, weather=W4), weather=W4))
