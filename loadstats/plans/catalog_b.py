"""Registered queries, part B: windows (G, D1-D4), aggregations (A), sorts (K),
anomalies and sampling (N, D5), forecasts and models (L, D6-D12), streams (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import anomaly, models, rollup, sample, series
from ..sources import fixtures as fx
from ..streaming import hourly as stream
from ..functions.stats import round_half_away
from .registry import query, r6, s6

H, MD, MR, GAP = "demand_hourly", "merged_daily", "merged_region", "demand_weather_gaps"
W4 = fx.WEATHER_COLS
N5 = fx.MERGED_NUMERIC
WIN = "WINDOW w AS (PARTITION BY city ORDER BY timestamp)"
MEAN = "avg(demand)"


def _lags_sql(lags, name="demand_lag_{n}h"):
    cols = ", ".join(f"lag(demand, {n}) OVER w AS {name.format(n=n)}" for n in lags)
    return f"SELECT *, {cols} FROM demand_hourly {WIN}"


# ============================================================== G: windows

@query("G1_lag_fixed", _lags_sql(series.BASE_LAGS), (H,))
def g1(spark, sf):
    return series.lag_features(fx.demand_hourly(spark, sf))


@query("G2_lag_grid", _lags_sql(sorted(set(series.GRID_LAGS)), "demand_lag_{n}"), (H,))
def g2(spark, sf):
    return series.lag_grid(fx.demand_hourly(spark, sf))


@query("G3_lag_grid_adaptive",
       "WITH b AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp) AS rn FROM demand_hourly), "
       "n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM demand_hourly GROUP BY city)), "
       "p AS (SELECT CASE WHEN n < 192 THEN greatest(24, n - 48) ELSE 168 END AS win FROM n), "
       "s AS (SELECT win, CASE WHEN win < 48 THEN 6 WHEN win < 72 THEN 12 ELSE 24 END AS step FROM p), "
       "l AS (SELECT CAST(unnest(generate_series(24, 24 + win - 1, step)) AS INTEGER) AS lag FROM s) "
       "SELECT b.city, b.timestamp, l.lag, prev.demand AS value FROM b CROSS JOIN l "
       "LEFT JOIN b prev ON prev.city = b.city AND prev.rn = b.rn - l.lag", (H,))
def g3(spark, sf):
    wide = series.lag_grid_adaptive(fx.demand_hourly(spark, sf))
    lag_cols = [c for c in wide.columns if c.startswith("demand_lag_")]
    long = wide.unpivot(["city", "timestamp"], lag_cols, "lag_name", "value")
    return long.select("city", "timestamp",
                       F.regexp_extract("lag_name", r"(\d+)$", 1).cast("int").alias("lag"), "value")


def _roll_sql(windows, stats=("mean", "std", "min", "max"), lo=None, hi=-1, suffix=""):
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    cols = []
    for n in windows:
        a = n if lo is None else lo
        frame = (f"ROWS BETWEEN {a} PRECEDING AND {'1 PRECEDING' if hi == -1 else 'CURRENT ROW'}")
        for s in stats:
            cols.append(f"CASE WHEN count(demand) OVER (PARTITION BY city ORDER BY timestamp {frame}) = {n} "
                        f"THEN {s6(f'{fn[s]}(demand) OVER (PARTITION BY city ORDER BY timestamp {frame})')} END "
                        f"AS demand_rolling_{s}{suffix}_{n}")
    return ", ".join(cols)


@query("G4_rolling_stats", f"SELECT city, timestamp, demand, {_roll_sql(series.ROLLING_WINDOWS)} FROM demand_hourly",
       (H,))
def g4(spark, sf):
    r = series.rolling_stats(fx.demand_hourly(spark, sf))
    names = [c for c in r.columns if c.startswith("demand_rolling_")]
    return r.select("city", "timestamp", "demand", *[r6(c).alias(c) for c in names])


@query("G5_rolling_inclusive",
       f"SELECT city, timestamp, demand, {_roll_sql([168], ('mean', 'std'), lo=167, hi=0, suffix='_incl')} "
       "FROM demand_hourly", (H,))
def g5(spark, sf):
    r = series.rolling_inclusive(fx.demand_hourly(spark, sf))
    return r.select("city", "timestamp", "demand", r6("demand_rolling_mean_incl_168").alias("demand_rolling_mean_incl_168"),
                    r6("demand_rolling_std_incl_168").alias("demand_rolling_std_incl_168"))


def _ewm_sql(span):
    b = 1.0 - 2.0 / (span + 1.0)
    frame = "OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return s6(f"sum(power({b!r}, -rn) * demand) {frame} / sum(power({b!r}, -rn)) {frame}") + f" AS demand_ewm_{span}"


@query("G6_ewm_mean",
       f"SELECT city, timestamp, demand, {_ewm_sql(24)}, {_ewm_sql(168)} FROM (SELECT *, "
       "row_number() OVER (PARTITION BY city ORDER BY timestamp) AS rn FROM demand_hourly)", (H,))
def g6(spark, sf):
    h = series.with_position(fx.demand_hourly(spark, sf))        # both means from one pass of positions
    e = series.ewm_mean(series.ewm_mean(h, 24, positioned=True), 168, positioned=True)
    return e.select("city", "timestamp", "demand", r6("demand_ewm_24").alias("demand_ewm_24"),
                    r6("demand_ewm_168").alias("demand_ewm_168"))


@query("G7_diff_n",
       f"SELECT city, timestamp, demand, demand - lag(demand, 24) OVER w AS demand_diff_1d, "
       f"demand - lag(demand, 168) OVER w AS demand_diff_1w FROM demand_hourly {WIN}", (H,))
def g7(spark, sf):
    return series.diff_features(fx.demand_hourly(spark, sf))


_PCT = ("coalesce(CASE WHEN l{n} = 0 THEN (CASE WHEN demand > 0 THEN 'inf'::DOUBLE WHEN demand < 0 THEN '-inf'::DOUBLE END) "
        "ELSE demand / l{n} - 1 END, CAST(0 AS DOUBLE))")


@query("G8_pct_change_n",
       f"SELECT city, timestamp, demand, {s6(_PCT.format(n=24))} AS demand_pct_change_1d, "
       f"{s6(_PCT.format(n=168))} AS demand_pct_change_1w FROM (SELECT *, lag(demand, 24) OVER w AS l24, "
       f"lag(demand, 168) OVER w AS l168 FROM demand_hourly {WIN})", (H,))
def g8(spark, sf):
    p = series.pct_change_features(fx.demand_hourly(spark, sf))
    return p.select("city", "timestamp", "demand", r6("demand_pct_change_1d").alias("demand_pct_change_1d"),
                    r6("demand_pct_change_1w").alias("demand_pct_change_1w"))


CORR_FEATURES = ["temperature", "humidity", "wind_speed", "pressure", "month", "dayofweek", "dayofyear"]


def _corr_base_sql():
    return ("SELECT *, CAST(month(timestamp) AS DOUBLE) AS month, CAST(isodow(timestamp) - 1 AS DOUBLE) AS dayofweek, "
            "CAST(dayofyear(timestamp) AS DOUBLE) AS dayofyear FROM merged_daily")


def _corr_base(spark, sf):
    md = fx.merged_daily(spark, sf)
    return md.select("*", F.month("timestamp").cast("double").alias("month"),
                     F.weekday("timestamp").cast("double").alias("dayofweek"),
                     F.dayofyear("timestamp").cast("double").alias("dayofyear"))


def _corr_target_sql():
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, demand)) AS abs_corr FROM ({_corr_base_sql()})"
                               for f in CORR_FEATURES)
    return f"SELECT feature, {s6('abs_corr')} AS abs_corr FROM ({parts})"


@query("G9_running_total_cut",
       f"SELECT feature, abs_corr FROM (SELECT *, sum(abs_corr) OVER (ORDER BY abs_corr DESC, feature "
       f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(abs_corr) OVER () AS tot "
       f"FROM ({_corr_target_sql()})) WHERE cum - abs_corr < 0.8 * tot", (MD,))
def g9(spark, sf):
    imp = rollup.corr_with_target(_corr_base(spark, sf), CORR_FEATURES).select("feature", r6("abs_corr").alias("abs_corr"))
    return series.running_total_cut(imp, "abs_corr", "feature").select("feature", "abs_corr")


@query("G10_rank_top_n_per_group",
       "SELECT * FROM (SELECT city, timestamp, demand, CAST(row_number() OVER w AS INTEGER) AS rank "
       f"FROM merged_daily {WIN}) WHERE rank <= 100", (MD,))
def g10(spark, sf):
    md = fx.merged_daily(spark, sf).select("city", "timestamp", "demand")
    return series.top_n_per_group(md, 100, "city")


@query("G11_sequence_windows",
       "SELECT city, timestamp, demand, sequence FROM (SELECT *, list(demand) OVER (PARTITION BY city ORDER BY timestamp "
       "ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS sequence FROM demand_hourly) WHERE len(sequence) = 24", (H,))
def g11(spark, sf):
    return series.sequence_windows(fx.demand_hourly(spark, sf))


@query("G12_tail_window",
       "SELECT city, timestamp, demand FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn "
       "FROM demand_hourly) WHERE rn <= 168", (H,))
def g12(spark, sf):
    return series.tail_window(fx.demand_hourly(spark, sf), 168)


# ============================================================== D1-D4: documented series baselines

@query("D1_naive_previous_week",
       f"SELECT city, timestamp, demand AS actual, predicted FROM (SELECT *, lag(demand, 168) OVER w AS predicted "
       f"FROM demand_hourly {WIN}) WHERE predicted IS NOT NULL", (H,))
def d1(spark, sf):
    p = series.naive_previous_week(fx.demand_hourly(spark, sf))
    return p.where(F.col("predicted").isNotNull()).select("city", "timestamp", F.col("demand").alias("actual"),
                                                         "predicted")


@query("D2_historical_average",
       "SELECT city, timestamp, demand, " +
       s6("avg(demand) OVER (PARTITION BY city, hour(timestamp), isodow(timestamp) ORDER BY timestamp "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") + " AS predicted FROM demand_hourly", (H,))
def d2(spark, sf):
    p = series.historical_average(fx.demand_hourly(spark, sf))
    return p.select("city", "timestamp", "demand", r6("predicted").alias("predicted"))


def _interp_sql(c, limit=3):
    ff = "OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bf = "OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    t = "CAST(epoch(timestamp) AS DOUBLE)"
    pv = f"last_value({c} IGNORE NULLS) {ff}"
    pt = f"last_value(CASE WHEN {c} IS NOT NULL THEN {t} END IGNORE NULLS) {ff}"
    pp = f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {ff}"
    nv = f"first_value({c} IGNORE NULLS) {bf}"
    nt = f"first_value(CASE WHEN {c} IS NOT NULL THEN {t} END IGNORE NULLS) {bf}"
    np_ = f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {bf}"
    interp = f"({pv}) + (({nv}) - ({pv})) * (({t} - ({pt})) / (({nt}) - ({pt})))"
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN ({np_}) - ({pp}) - 1 <= {limit} "
            f"THEN {s6(interp)} END AS {c}")


@query("D3_interpolate_linear",
       "SELECT city, timestamp, demand, " + ", ".join(_interp_sql(c) for c in W4) +
       " FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp) - 1 AS rn FROM demand_weather_gaps)",
       (GAP,))
def d3(spark, sf):
    g = fx.materialize(fx.demand_weather_gaps(spark, sf)).select("*", *[F.col(c).alias(f"_o_{c}") for c in W4])
    i = series.interpolate_linear(g, W4, limit=3)
    # observed values pass through untouched; only interpolated ones are rounded
    return i.select("city", "timestamp", "demand",
                    *[F.coalesce(F.col(f"_o_{c}"), r6(c)).alias(c) for c in W4])


@query("D4_rolling_zscore",
       "SELECT city, timestamp, demand, " +
       s6("(demand - CASE WHEN c = 24 THEN m END) / CASE WHEN c = 24 THEN s END") + " AS demand_rolling_z_24 FROM ("
       "SELECT *, count(demand) OVER f AS c, avg(demand) OVER f AS m, stddev_samp(demand) OVER f AS s FROM demand_hourly "
       "WINDOW f AS (PARTITION BY city ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))", (H,))
def d4(spark, sf):
    z = series.rolling_zscore(fx.demand_hourly(spark, sf), 24)
    return z.select("city", "timestamp", "demand", r6("demand_rolling_z_24").alias("demand_rolling_z_24"))


# ============================================================== A: aggregations

@query("A1_daily_summary",
       f"SELECT substr(city, 1, 1) AS city, CAST(timestamp AS DATE) AS date, {s6(MEAN)} AS avg_demand, "
       f"max(demand) AS max_demand, min(demand) AS min_demand, {s6('avg(temperature)')} AS avg_temp "
       "FROM merged_daily GROUP BY 1, 2", (MD,))
def a1(spark, sf):
    # nations by initial, so that a group holds several readings of a day
    d = rollup.daily_summary(fx.merged_daily(spark, sf).withColumn("city", F.substring("city", 1, 1)))
    return d.select("city", "date", r6("avg_demand").alias("avg_demand"), "max_demand", "min_demand",
                    r6("avg_temp").alias("avg_temp"))


@query("A2_weekly_summary",
       f"SELECT city, CAST(isoyear(timestamp) AS INTEGER) AS iso_year, CAST(weekofyear(timestamp) AS INTEGER) AS week, "
       f"{s6(MEAN)} AS avg_demand, {s6('avg(temperature)')} AS avg_temp FROM merged_daily GROUP BY 1, 2, 3",
       (MD,))
def a2(spark, sf):
    w = rollup.weekly_summary(fx.merged_daily(spark, sf))
    return w.select("city", "iso_year", "week", r6("avg_demand").alias("avg_demand"), r6("avg_temp").alias("avg_temp"))


def _profile_q(part, sql_part, view, fn_view):
    @query(f"A{ {'hour': 3, 'dayofweek': 4, 'month': 5}[part] }_{ {'hour': 'hourly', 'dayofweek': 'weekday', 'month': 'monthly'}[part] }_profile",
           f"SELECT CAST({sql_part} AS INTEGER) AS {part}, "
           f"{s6('CAST(sum(CAST(demand AS DECIMAL(28, 4))) AS DOUBLE) / count(demand)')} AS avg_demand, count(demand) AS n "
           f"FROM {view} GROUP BY 1", (view,))
    def q(spark, sf):
        p = rollup.profile_by(fn_view(spark, sf), part, scale=4)   # money and readings: two decimals
        return p.select(part, r6("avg_demand").alias("avg_demand"), "n")
    return q


_profile_q("hour", "hour(timestamp)", H, fx.demand_hourly)
_profile_q("dayofweek", "isodow(timestamp) - 1", H, fx.demand_hourly)
_profile_q("month", "month(timestamp)", MD, fx.merged_daily)


def _describe_sql(cols, view):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, "
                     f"round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, "
                     f"round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, "
                     f"round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM {view}")
    return " UNION ALL ".join(parts)


@query("A6_describe", _describe_sql(N5, MD), (MD,))
def a6(spark, sf):
    return rollup.describe(fx.merged_daily(spark, sf), N5)


def _ext_sql(cols, view):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(median({c}), 2) AS median, "
                     f"round(stddev_samp({c}), 2) AS std, round(skewness({c}), 2) AS skewness, "
                     f"round(kurtosis({c}), 2) AS kurtosis, round(min({c}), 2) AS min, round(max({c}), 2) AS max "
                     f"FROM {view}")
    return " UNION ALL ".join(parts)


@query("A7_extended_stats", _ext_sql(N5, MD), (MD,))
def a7(spark, sf):
    return rollup.extended_stats(fx.merged_daily(spark, sf), N5)


_VC_COLS = ["o_orderstatus", "o_orderpriority"]


@query("A8_value_counts_top",
       "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM orders "
                                           f"WHERE {c} IS NOT NULL" for c in _VC_COLS) + "), "
       "c AS (SELECT \"column\", value, count(*) AS count FROM l GROUP BY 1, 2), "
       "u AS (SELECT \"column\", count(*) AS n_unique FROM c GROUP BY 1) "
       "SELECT c.\"column\", value, count, rank, n_unique FROM (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" "
       "ORDER BY count DESC, value) AS INTEGER) AS rank FROM c) c JOIN u ON c.\"column\" = u.\"column\" WHERE rank <= 5")
def a8(spark, sf):
    return rollup.value_counts_top(fx.table(spark, sf, "orders"), _VC_COLS, 5)


_HLL_COLS = ["o_custkey", "o_orderdate", "o_orderpriority"]


@query("A8_distinct_sketches",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_unique, true AS estimate_ok "
                          "FROM orders" for c in _HLL_COLS))
def a8_sketches(spark, sf):
    """One sketch a day and column, kept as a table and merged; the exact count beside it and
    whether the estimate lies within four standard errors."""
    orders = fx.table(spark, sf, "orders")
    kept = fx.materialize(rollup.distinct_sketches(orders, _HLL_COLS, F.date_format("o_orderdate", "yyyy-MM")))
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in _HLL_COLS]).unpivot(
        [], _HLL_COLS, "column", "exact")
    both = rollup.distinct_estimates(kept).join(exact, "column")
    near = F.abs(F.col("n_unique") - F.col("exact")) <= F.lit(4 * 0.0082) * F.col("exact") + 1
    return both.select("column", "n", F.col("exact").alias("n_unique"), near.alias("estimate_ok"))


@query("A9_value_share",
       f"SELECT o_orderpriority, {s6('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM orders GROUP BY 1")
def a9(spark, sf):
    s = rollup.value_share(fx.table(spark, sf, "orders"), "o_orderpriority")
    return s.select("o_orderpriority", r6("share").alias("share"))


_SEASON_SQL = ("CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) IN (3, 4, 5) THEN 'spring' "
               "WHEN month(timestamp) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")


@query("A10_dataset_profile",
       "WITH m AS (SELECT city, avg(demand) AS md, avg(temperature) AS mt FROM merged_daily GROUP BY 1) "
       "SELECT strftime(min(timestamp), '%Y-%m-%d') AS data_start_date, strftime(max(timestamp), '%Y-%m-%d') AS data_end_date, "
       "count(*) AS total_records, list_sort(list(DISTINCT city)) AS cities, "
       f"{s6('avg(demand)')} AS avg_demand, min(demand) AS min_demand, max(demand) AS max_demand, "
       f"{s6('avg(temperature)')} AS avg_temperature, list_sort(list(DISTINCT {_SEASON_SQL})) AS seasons, "
       "(SELECT city FROM m ORDER BY md DESC, city LIMIT 1) AS highest_demand_city, "
       "(SELECT city FROM m ORDER BY md ASC, city LIMIT 1) AS lowest_demand_city, "
       "(SELECT city FROM m ORDER BY mt DESC, city LIMIT 1) AS hottest_city, "
       "(SELECT city FROM m ORDER BY mt ASC, city LIMIT 1) AS coldest_city FROM merged_daily", (MD,))
def a10(spark, sf):
    md = fx.merged_daily(spark, sf).withColumn("season", cal.season(F.month("timestamp")))
    p = rollup.dataset_profile(md)
    return p.withColumn("avg_demand", r6("avg_demand")).withColumn("avg_temperature", r6("avg_temperature"))


@query("A11_group_argmax",
       "WITH m AS (SELECT city, avg(demand) AS md FROM merged_daily GROUP BY 1) "
       "SELECT (SELECT city FROM m ORDER BY md DESC, city LIMIT 1) AS max_demand_city, "
       "(SELECT city FROM m ORDER BY md ASC, city LIMIT 1) AS min_demand_city", (MD,))
def a11(spark, sf):
    return rollup.group_argmax(fx.merged_daily(spark, sf), "city", "demand")


def _corr_long_sql(cols, view, ordered=True, digits=2):
    import itertools
    parts = []
    for a, b in itertools.combinations(cols, 2):
        parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {digits}) AS r FROM {view}")
        if ordered:
            parts.append(f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}, {b}), {digits}) AS r FROM {view}")
    if ordered:
        parts += [f"SELECT '{c}' AS a, '{c}' AS b, CAST(1 AS DOUBLE) AS r" for c in cols]
    return " UNION ALL ".join(parts)


@query("A12_corr_matrix", _corr_long_sql(N5, GAP), (GAP,))
def a12(spark, sf):
    # weather is NULL on days without shipments: each pair counts the days that have both
    return rollup.corr_matrix(fx.demand_weather_gaps(spark, sf), N5)


_A13_COLS = ["demand", "temperature", "humidity", "wind_speed", "pressure"]


@query("A13_high_corr_pairs",
       f"SELECT * FROM ({_corr_long_sql(_A13_COLS, 'merged_region', ordered=False)}) WHERE abs(r) >= 0.7", (MR,))
def a13(spark, sf):
    return rollup.high_corr_pairs(fx.merged_region(spark, sf), _A13_COLS)


@query("A14_corr_with_target",
       f"SELECT feature, abs_corr, CAST(row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS INTEGER) AS rank "
       f"FROM ({_corr_target_sql()})", (MD,))
def a14(spark, sf):
    c = rollup.corr_with_target(_corr_base(spark, sf), CORR_FEATURES)
    c = c.select("feature", r6("abs_corr").alias("abs_corr"))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")   # one row per feature
    return c.withColumn("rank", F.row_number().over(w))


def _flags_sql(view, cols):
    zsql = " OR ".join(f"coalesce(abs(({c} - mu_{c}) / sd_{c}) > 3, false)" for c in cols)
    isql = " OR ".join(f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false)"
                       for c in cols)
    st = ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}, quantile_cont({c}, 0.25) AS q1_{c}, "
                   f"quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    return f"SELECT b.*, ({zsql}) AS anomaly_z, ({isql}) AS anomaly_iqr FROM {view} b, (SELECT {st} FROM {view}) s"


def _flagged(spark, sf, view=fx.merged_daily):
    return anomaly.anomaly_z_and_iqr(fx.materialize(view(spark, sf)), N5)


@query("A15_anomaly_rate_by_city",
       "SELECT city, count(demand) AS total_records, CAST(count_if(anomaly_z) AS BIGINT) AS z_anomalies, "
       f"CAST(count_if(anomaly_iqr) AS BIGINT) AS iqr_anomalies, {s6('count_if(anomaly_z) * 100.0 / count(demand)')} AS z_pct, "
       f"{s6('count_if(anomaly_iqr) * 100.0 / count(demand)')} AS iqr_pct FROM ({_flags_sql(MD, N5)}) GROUP BY city", (MD,))
def a15(spark, sf):
    r = rollup.anomaly_rate_by_city(_flagged(spark, sf))
    return r.select("city", "total_records", "z_anomalies", "iqr_anomalies", r6("z_pct").alias("z_pct"),
                    r6("iqr_pct").alias("iqr_pct"))


@query("A16_cleaning_report",
       "SELECT count(*) AS rows_before, CAST(count_if(NOT anomaly_iqr) AS BIGINT) AS rows_after, "
       "CAST(count(*) - count_if(NOT anomaly_iqr) AS BIGINT) AS rows_removed, "
       f"round((count(*) - count_if(NOT anomaly_iqr)) * 100.0 / count(*), 2) AS pct_removed FROM ({_flags_sql(MD, N5)})",
       (MD,))
def a16(spark, sf):
    return rollup.cleaning_report(_flagged(spark, sf))


def _naive_sql(n, test_only=True):
    where = "WHERE rn >= floor(cnt * CAST(0.8 AS DOUBLE)) AND" if test_only else "WHERE"
    return (f"SELECT city, timestamp, demand AS actual, predicted FROM ("
            f"SELECT *, lag(demand, {n}) OVER w AS predicted, row_number() OVER w - 1 AS rn, "
            f"count(*) OVER (PARTITION BY city) AS cnt FROM demand_hourly {WIN}) {where} predicted IS NOT NULL")


def _metrics_sql(src, by=None):
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}{s6('avg(abs(actual - predicted))')} AS mae, "
            f"{s6('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse, "
            f"{s6('avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) * 100')} AS mape, "
            f"{s6('1 - sum((actual - predicted) * (actual - predicted)) / (count(actual) * var_pop(actual))')} AS r2, "
            f"count(actual) AS n FROM ({src}) WHERE actual IS NOT NULL AND predicted IS NOT NULL{group}")


def _metrics_round(df):
    return df.select(*[c for c in df.columns if c not in ("mae", "rmse", "mape", "r2", "n")],
                     *[r6(c).alias(c) for c in ("mae", "rmse", "mape", "r2")], "n")


@query("A17_regression_metrics", _metrics_sql(_naive_sql(24)), (H,))
def a17(spark, sf):
    p = models.naive_forecast(fx.demand_hourly(spark, sf))
    return _metrics_round(rollup.regression_metrics(p))


def _model_table_sql():
    hist = ("SELECT city, timestamp, demand AS actual, avg(demand) OVER (PARTITION BY city, hour(timestamp), "
            "isodow(timestamp) ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted "
            "FROM demand_hourly")
    split = ("SELECT city, timestamp FROM (SELECT city, timestamp, row_number() OVER w - 1 AS rn, "
             f"count(*) OVER (PARTITION BY city) AS cnt FROM demand_hourly {WIN}) WHERE rn >= floor(cnt * CAST(0.8 AS DOUBLE))")
    return (f"SELECT 'naive_day' AS model, * FROM ({_naive_sql(24)}) UNION ALL "
            f"SELECT 'naive_week' AS model, * FROM ({_naive_sql(168)}) UNION ALL "
            f"SELECT 'historical_average' AS model, h.* FROM ({hist}) h JOIN ({split}) s "
            "ON h.city = s.city AND h.timestamp = s.timestamp WHERE h.predicted IS NOT NULL")


def _model_table(spark, sf):
    h = fx.demand_hourly(spark, sf)
    a = models.naive_forecast(h, horizon=24).withColumn("model", F.lit("naive_day"))
    b = models.naive_forecast(h, horizon=168).withColumn("model", F.lit("naive_week"))
    hist = series.historical_average(h)
    test = sample.split_chronological(h).where(F.col("split") == "test").select("city", "timestamp")
    c = hist.join(test, ["city", "timestamp"]).where(F.col("predicted").isNotNull()) \
            .select("city", "timestamp", F.col("demand").alias("actual"), "predicted",
                    F.lit("historical_average").alias("model"))
    return a.unionByName(b).unionByName(c)


@query("A18_compare_models", _metrics_sql(_model_table_sql(), "model"), (H,))
def a18(spark, sf):
    return _metrics_round(rollup.regression_metrics(_model_table(spark, sf), by="model"))


@query("A19_best_model",
       f"SELECT model AS best_model, mae AS best_mae FROM ({_metrics_sql(_model_table_sql(), 'model')}) "
       "ORDER BY mae, model LIMIT 1", (H,))
def a19(spark, sf):
    m = _metrics_round(rollup.regression_metrics(_model_table(spark, sf), by="model"))
    return rollup.best_model(m)


# ============================================================== K: sorts and top-k

@query("K1_sort_city_time", "SELECT * FROM demand_hourly ORDER BY city, timestamp", (H,))
def k1(spark, sf):
    return rollup.sort_city_time(fx.demand_hourly(spark, sf))


@query("K2_topk_features_corr",
       f"SELECT feature, abs_corr FROM ({_corr_target_sql()}) ORDER BY abs_corr DESC, feature "
       f"LIMIT {int(len(CORR_FEATURES) * 0.7)}", (MD,))
def k2(spark, sf):
    c = rollup.corr_with_target(_corr_base(spark, sf), CORR_FEATURES).select("feature", r6("abs_corr").alias("abs_corr"))
    return rollup.topk_by(c, "abs_corr", int(len(CORR_FEATURES) * 0.7))


@query("K4_first_cities", "SELECT DISTINCT city FROM merged_daily ORDER BY city LIMIT 3", (MD,))
def k4(spark, sf):
    return rollup.first_groups(fx.merged_daily(spark, sf), 3)


# ============================================================== N: anomalies, sampling, splits

@query("N1_anomaly_zscore", f"SELECT city, timestamp, anomaly_z FROM ({_flags_sql(MD, N5)})", (MD,))
def n1(spark, sf):
    return anomaly.anomaly_zscore(fx.merged_daily(spark, sf), N5).select("city", "timestamp", "anomaly_z")


@query("N2_anomaly_iqr", f"SELECT city, timestamp, anomaly_iqr FROM ({_flags_sql(MD, N5)})", (MD,))
def n2(spark, sf):
    return anomaly.anomaly_iqr(fx.merged_daily(spark, sf), N5).select("city", "timestamp", "anomaly_iqr")


@query("N4_anomaly_any",
       f"SELECT city, timestamp, CAST(anomaly_z OR anomaly_iqr AS INTEGER) AS is_anomaly FROM ({_flags_sql(MD, N5)})",
       (MD,))
def n4(spark, sf):
    return anomaly.anomaly_any(_flagged(spark, sf)).select("city", "timestamp", "is_anomaly")


@query("N5_clean_dataset",
       f"SELECT city, timestamp, demand, temperature, humidity, wind_speed, pressure FROM ({_flags_sql(MD, N5)}) "
       "WHERE NOT anomaly_iqr", (MD,))
def n5(spark, sf):
    return anomaly.clean_dataset(fx.merged_daily(spark, sf), N5)


SAMPLE_N = 5000


def _events_strata(spark, sf):
    ev = fx.table(spark, sf, "events")
    return ev.select("event_id", F.col("event_type").alias("city"), "ts", "value", "user_id",
                     F.hour("ts").alias("hour"), F.weekday("ts").alias("dayofweek"))


_EV_SQL = ("SELECT event_id, event_type AS city, ts, value, user_id, CAST(hour(ts) AS INTEGER) AS hour, "
           "CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek FROM events")


def _sample_sql(strata, n, seed=42):
    key = "concat_ws('_', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in strata) + ")"
    return (f"WITH e AS ({_EV_SQL}), k AS (SELECT *, {key} AS stratum, "
            f"md5(concat_ws('|', CAST(event_id AS VARCHAR), '{seed}')) AS h FROM e), "
            "c AS (SELECT stratum, count(*) AS cnt FROM k GROUP BY 1), "
            "t AS (SELECT sum(cnt) AS total FROM c), "
            f"q0 AS (SELECT stratum, cnt, CAST(floor(cnt * least({n}, total) / total) AS BIGINT) AS base, "
            f"(cnt * least({n}, total)) % total AS rem, least({n}, total) AS nn FROM c, t), "
            "q1 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, stratum) AS r, sum(base) OVER () AS bt FROM q0), "
            "q AS (SELECT stratum, base + CASE WHEN r <= nn - bt THEN 1 ELSE 0 END AS quota FROM q1) "
            "SELECT event_id, city, ts, value, user_id, hour, dayofweek FROM (SELECT k.*, q.quota, row_number() OVER "
            "(PARTITION BY k.stratum ORDER BY h, event_id) AS rk FROM k JOIN q ON k.stratum = q.stratum) WHERE rk <= quota")


def _n6_sample(spark, sf):
    return sample.stratified_sample(_events_strata(spark, sf), ["city", "hour", "dayofweek"], SAMPLE_N, ["event_id"])


@query("N6_stratified_sample", _sample_sql(["city", "hour", "dayofweek"], SAMPLE_N))
def n6(spark, sf):
    return _n6_sample(spark, sf)


@query("N7_strata_reduction", _sample_sql(["city", "hour"], SAMPLE_N))
def n7(spark, sf):
    return sample.sample_with_fallback(_events_strata(spark, sf), ["city", "hour", "dayofweek"], SAMPLE_N,
                                       ["event_id"])


@query("N8_strata_fallback", _sample_sql(["city"], 100))
def n8(spark, sf):
    return sample.sample_with_fallback(_events_strata(spark, sf), ["city", "hour", "dayofweek"], 100, ["event_id"])


_VAL_COLS = ["value", "user_id"]


def _validation_sql():
    s = _sample_sql(["city", "hour", "dayofweek"], SAMPLE_N)
    s_body = s[len("WITH "):]
    parts = []
    for c in _VAL_COLS:
        stats = lambda src, p: (f"avg({c}) AS {p}mean, median({c}) AS {p}median, stddev_samp({c}) AS {p}std, "  # noqa: E731
                                f"CAST(min({c}) AS DOUBLE) AS {p}min, CAST(max({c}) AS DOUBLE) AS {p}max FROM {src}")
        parts.append(f"SELECT '{c}' AS \"column\", * FROM (SELECT {stats('e', '')}), (SELECT {stats('smp', 'sample_')})")
    body = " UNION ALL ".join(parts)
    diffs = ", ".join(s6(f"CASE WHEN {m} <> 0 THEN (sample_{m} - {m}) / {m} * 100 ELSE 0.0 END") + f" AS {m}_diff_pct"
                      for m in ["mean", "median", "std", "min", "max"])
    rounded = ", ".join(f"{s6(m)} AS {m}, {s6('sample_' + m)} AS sample_{m}" for m in ["mean", "median", "std", "min", "max"])
    return f"WITH smp AS (WITH {s_body}), e AS ({_EV_SQL}), v AS ({body}) SELECT \"column\", {rounded}, {diffs} FROM v"


def _validation(spark, sf):
    full = _events_strata(spark, sf)
    v = sample.sample_validation(full, _n6_sample(spark, sf), _VAL_COLS)
    names = ["mean", "median", "std", "min", "max"]
    return v.select("column", *[x for m in names for x in (r6(m).alias(m), r6(f"sample_{m}").alias(f"sample_{m}"))],
                    *[r6(f"{m}_diff_pct").alias(f"{m}_diff_pct") for m in names])


@query("N9_sample_validation", _validation_sql())
def n9(spark, sf):
    return _validation(spark, sf)


@query("N10_sample_drift_flags",
       f"SELECT \"column\", mean_diff_pct, median_diff_pct, std_diff_pct FROM ({_validation_sql()}) "
       "WHERE abs(mean_diff_pct) > 5 OR abs(median_diff_pct) > 5 OR abs(std_diff_pct) > 5")
def n10(spark, sf):
    return sample.sample_drift_flags(_validation(spark, sf))


def _dist_sql():
    s = _sample_sql(["city", "hour", "dayofweek"], SAMPLE_N)[len("WITH "):]
    def shares(src, name):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) * 1.0 / sum(count(*)) OVER () AS {name} "
            f"FROM {src} GROUP BY 2" for c in ["city", "hour", "dayofweek"])
    return (f"WITH smp AS (WITH {s}), e AS ({_EV_SQL}), a AS ({shares('e', 'full_share')}), "
            f"b AS ({shares('smp', 'sample_share')}) SELECT coalesce(a.\"column\", b.\"column\") AS \"column\", "
            f"coalesce(a.value, b.value) AS value, {s6('coalesce(full_share, 0.0)')} AS full_share, "
            f"{s6('coalesce(sample_share, 0.0)')} AS sample_share FROM a FULL OUTER JOIN b "
            "ON a.\"column\" = b.\"column\" AND a.value = b.value")


@query("N11_distribution_compare", _dist_sql())
def n11(spark, sf):
    d = sample.distribution_compare(_events_strata(spark, sf), _n6_sample(spark, sf), ["city", "hour", "dayofweek"])
    return d.select("column", "value", r6("full_share").alias("full_share"), r6("sample_share").alias("sample_share"))


@query("N12_split_chronological",
       "SELECT city, timestamp, demand, CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE)) "
       f"THEN 'train' ELSE 'test' END AS split FROM demand_hourly {WIN}", (H,))
def n12(spark, sf):
    return sample.split_chronological(fx.demand_hourly(spark, sf))


@query("D5_split_70_15_15",
       "SELECT city, timestamp, demand, CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY city) * CAST(0.7 AS DOUBLE)) "
       "THEN 'train' WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY city) * CAST(0.85 AS DOUBLE)) THEN 'validation' "
       f"ELSE 'test' END AS split FROM demand_hourly {WIN}", (H,))
def d5(spark, sf):
    return sample.split_three_way(fx.demand_hourly(spark, sf))


# ============================================================== L: forecasts

@query("L1_naive_forecast", _naive_sql(24), (H,))
def l1(spark, sf):
    return models.naive_forecast(fx.demand_hourly(spark, sf))


def _stack_src_sql():
    return (f"SELECT city, timestamp, demand AS actual, lag(demand, 24) OVER w AS pa, lag(demand, 168) OVER w AS pb "
            f"FROM demand_hourly {WIN}")


def _stack_sql():
    src = f"SELECT * FROM ({_stack_src_sql()}) WHERE pa IS NOT NULL AND pb IS NOT NULL"
    st = ("SELECT count(*) AS n, avg(pa) AS ma, avg(pb) AS mb, avg(actual) AS my, covar_pop(pa, pa) * count(*) + 0.5 AS s11, "
          "covar_pop(pa, pb) * count(*) AS s12, covar_pop(pb, pb) * count(*) + 0.5 AS s22, "
          "covar_pop(pa, actual) * count(*) AS r1, covar_pop(pb, actual) * count(*) AS r2 FROM d")
    coef = ("SELECT *, (s22 * r1 - s12 * r2) / (s11 * s22 - s12 * s12) AS c1, "
            "(s11 * r2 - s12 * r1) / (s11 * s22 - s12 * s12) AS c2 FROM st")
    return (f"WITH d AS ({src}), st AS ({st}), cf AS ({coef}) SELECT city, timestamp, actual, "
            "round(my - ma * c1 - mb * c2 + c1 * pa + c2 * pb, 4) + 0.0 AS predicted FROM d, cf")


def _stack_input(spark, sf):
    src = series.lag_features(fx.demand_hourly(spark, sf), (24, 168), name="p{n}")
    return src.select("city", "timestamp", F.col("demand").alias("actual"), F.col("p24").alias("pa"),
                      F.col("p168").alias("pb")).where(F.col("pa").isNotNull() & F.col("pb").isNotNull())


@query("L5_stack_ridge", _stack_sql(), (H,))
def l5(spark, sf):
    d = _stack_input(spark, sf)
    fit = models.ridge_fit(d, ["pa", "pb"], "actual")
    return d.select("city", "timestamp", "actual",
                    (round_half_away(models.ridge_expr(fit, ["pa", "pb"]), 4) + F.lit(0.0)).alias("predicted"))


@query("L6_weight_grid",
       "WITH d AS (SELECT * FROM (" + _stack_src_sql() + ") WHERE pa IS NOT NULL AND pb IS NOT NULL), "
       "g AS (" + " UNION ALL ".join(
           f"SELECT CAST({wa} AS DOUBLE) AS w_a, CAST({wb} AS DOUBLE) AS w_b, {i} AS i, "
           f"avg(abs(actual - ({wa} * pa + {wb} * pb))) AS mae FROM d" for i, (wa, wb) in enumerate(models.WEIGHT_OPTIONS)) +
       f") SELECT w_a, w_b, {s6('mae')} AS mae, i = (SELECT i FROM g ORDER BY mae, i LIMIT 1) AS is_best FROM g", (H,))
def l6(spark, sf):
    g = models.weight_grid(_stack_input(spark, sf), "pa", "pb")
    return g.select("w_a", "w_b", r6("mae").alias("mae"), "is_best")


@query("L7_serve_ensemble",
       f"SELECT city, timestamp, actual, {s6('predicted * 0.97')} AS predicted, "
       f"{s6('greatest(0.0, predicted * 0.97 * CAST(0.85 AS DOUBLE))')} AS lower, {s6('predicted * 0.97 * 1.15')} AS upper "
       f"FROM ({_naive_sql(24)})", (H,))
def l7(spark, sf):
    p = models.naive_forecast(fx.demand_hourly(spark, sf))
    e = p.withColumn("predicted", models.serve_ensemble(F.col("predicted")))
    lo, hi = models.confidence_bounds(F.col("predicted"), "ensemble")
    return e.select("city", "timestamp", "actual", r6("predicted").alias("predicted"), r6(lo).alias("lower"),
                    r6(hi).alias("upper"))


@query("L8_confidence_bounds",
       f"SELECT city, timestamp, {s6('greatest(0.0, coalesce(predicted, 0.0) * 0.9)')} AS lower, "
       f"{s6('coalesce(predicted, 0.0) * 1.1')} AS upper FROM ({_naive_sql(24)})", (H,))
def l8(spark, sf):
    p = models.naive_forecast(fx.demand_hourly(spark, sf))
    lo, hi = models.confidence_bounds(F.col("predicted"), "xgboost")
    return p.select("city", "timestamp", r6(lo).alias("lower"), r6(hi).alias("upper"))


@query("L9_forecast_table",
       f"SELECT 'xgboost' AS model, city, timestamp, actual, predicted, {s6('greatest(0.0, predicted * 0.9)')} AS lower, "
       f"{s6('predicted * 1.1')} AS upper, count(*) OVER (PARTITION BY city) AS count FROM ({_naive_sql(24)})", (H,))
def l9(spark, sf):
    t = models.forecast_table(models.naive_forecast(fx.demand_hourly(spark, sf)), "xgboost")
    counts = t.groupBy("city").agg(F.count(F.lit(1)).alias("count"))
    return t.join(counts, "city").select("model", "city", "timestamp", "actual", "predicted",
                                        r6("lower").alias("lower"), r6("upper").alias("upper"), "count")


# ============================================================== D6, D12: evaluation

def _fold_sql():
    cases = " ".join(f"WHEN rn >= floor(cnt * CAST({0.5 + (f - 1) * 0.1!r} AS DOUBLE)) AND rn < floor(cnt * CAST({0.5 + f * 0.1!r} AS DOUBLE)) THEN {f}"
                     for f in range(1, 6))
    return (f"SELECT city, timestamp, actual, predicted, CASE {cases} END AS fold FROM ("
            f"SELECT city, timestamp, demand AS actual, lag(demand, 24) OVER w AS predicted, row_number() OVER w - 1 AS rn, "
            f"count(*) OVER (PARTITION BY city) AS cnt FROM demand_hourly {WIN})")


@query("D6_rolling_origin_eval",
       _metrics_sql(f"SELECT * FROM ({_fold_sql()}) WHERE fold IS NOT NULL", "fold"), (H,))
def d6(spark, sf):
    h = fx.demand_hourly(spark, sf)
    lagged = series.lag_features(h, (24,), name="predicted")
    folds = models.rolling_origin_folds(lagged)
    p = folds.where(F.col("fold").isNotNull()).select("fold", "city", "timestamp", F.col("demand").alias("actual"),
                                                     "predicted")
    return _metrics_round(rollup.regression_metrics(p, by="fold"))


@query("D12_within_margin_rate",
       f"SELECT {s6('avg(CAST(abs(actual - predicted) <= 0.1 * abs(actual) AS INTEGER))')} AS within_rate, count(*) AS n "
       f"FROM ({_naive_sql(24)})", (H,))
def d12(spark, sf):
    w = models.within_margin_rate(models.naive_forecast(fx.demand_hourly(spark, sf)), 0.1)
    return w.select(r6("within_rate").alias("within_rate"), "n")


# ============================================================== X: streams (batch twins as oracles)

@query("X1_stream_hourly_demand", "SELECT * FROM demand_hourly", (H,))
def x1(spark, sf):
    return stream.run_hourly_demand(spark, f"{sf.rstrip('/')}/events.parquet")


@query("X2_stream_flag_anomalies",
       "SELECT event_id, event_type, ts, value, coalesce(abs((value - mu) / sd) > 3, false) AS anomaly_z FROM events "
       "LEFT JOIN (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM events GROUP BY 1) USING (event_type)")
def x2(spark, sf):
    return stream.run_flag_stream(spark, f"{sf.rstrip('/')}/events.parquet")


from . import catalog_models  # noqa: E402,F401  (model-backed queries: L2-L4, L10-L14, K3, N3, D7-D11)
