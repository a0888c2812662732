"""Registered queries, part A: sources (S), projections (P), joins (J),
missing values (M), scalar features (E) and scaling (F)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import anomaly, clean, scale, series
from ..sources import fixtures as fx
from ..sources import readers
from .registry import query, r6, s6

H, MD, MR, GAP = "demand_hourly", "merged_daily", "merged_region", "demand_weather_gaps"
W4 = fx.WEATHER_COLS
N5 = fx.MERGED_NUMERIC


def _t(spark, sf, name):
    return fx.table(spark, sf, name)


# ============================================================== S: sources and sinks

@query("S1_scan_csv", "SELECT * FROM demand_hourly", (H,))
def s1(spark: SparkSession, sf: str):
    return readers.roundtrip_csv(spark, fx.demand_hourly(spark, sf))


@query("S2_scan_glob")
def s2(spark, sf):
    return readers.roundtrip_glob(spark, fx.demand_hourly(spark, sf))


@query("S3_scan_weather_json")
def s3(spark, sf):
    return readers.roundtrip_weather_json(spark, fx.weather_daily(spark, sf))


@query("S4_flatten_nested_json",
       "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def s4(spark, sf):
    return readers.flatten_json_column(_t(spark, sf, "events"), "props", "k INT", keep=["event_id"])


@query("S5_require_columns")
def s5(spark, sf):
    """Sources in preference order: the events table is used, a missing path and a
    table without the required columns are reported and skipped."""
    sources = [f"{sf}/events.parquet", f"{sf}/no_such_source.parquet", f"{sf}/nation.parquet"]
    out = readers.load_sources(spark, sources, ["event_id", "ts", "event_type", "value"])
    return readers.require_columns(out, ["event_id", "ts", "event_type", "value"])


@query("S6_first_available_source", "SELECT * FROM events")
def s6_(spark, sf):
    return readers.first_available(spark, [f"{sf}/no_such_table.parquet", f"{sf}/events.parquet"])


@query("S7_write_tables")
def s7(spark, sf):
    return readers.write_tables_roundtrip(spark, fx.merged_daily(spark, sf))


@query("S8_write_metrics")
def s8(spark, sf):
    return readers.write_metrics_roundtrip(spark, fx.demand_hourly(spark, sf))


@query("S9_save_load_models")
def s9(spark, sf):
    return readers.model_roundtrip(spark, fx.merged_daily(spark, sf))


def _profile_sql(view, cols_types, only_missing):
    parts = []
    for c, t in cols_types:
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
                     f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
                     f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM {view}")
    sql = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({sql}) WHERE null_count > 0" if only_missing else sql


GAP_TYPES = [("city", "string"), ("timestamp", "timestamp_ntz")] + [(c, "double") for c in ["demand"] + W4]


@query("S10_schema_profile", _profile_sql(GAP, GAP_TYPES, False), (GAP,))
def s10(spark, sf):
    return clean.missing_profile(fx.demand_weather_gaps(spark, sf), only_missing=False)


# ============================================================== P: projections and filters

_CANON = "regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '\\s+', '_', 'g')"


@query("P1_canonical_city",
       f"SELECT 'nation' AS src, n_name AS raw, {_CANON.format(c='n_name')} AS canonical FROM nation "
       f"UNION ALL SELECT 'region', r_name, {_CANON.format(c='r_name')} FROM region "
       f"UNION ALL SELECT 'part', p_name, {_CANON.format(c='p_name')} FROM part")
def p1(spark, sf):
    def one(t, c, tag):
        return _t(spark, sf, t).select(F.lit(tag).alias("src"), F.col(c).alias("raw"),
                                       cal.canonical_city(c).alias("canonical"))
    return one("nation", "n_name", "nation").unionByName(one("region", "r_name", "region")) \
                                              .unionByName(one("part", "p_name", "part"))


@query("P2_parse_timestamp",
       "SELECT event_id, ts AS timestamp, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp_from_epoch "
       "FROM events")
def p2(spark, sf):
    ev = _t(spark, sf, "events")
    text = ev.select("event_id", F.col("ts").cast("string").alias("utc_time"),
                     F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("time"))
    return text.select("event_id",
                       cal.parse_timestamp(text.select("utc_time")).alias("timestamp"),
                       cal.parse_timestamp(text.select("time"), ("time",)).alias("timestamp_from_epoch"))


@query("P3_project_rename_keep",
       "SELECT ts AS timestamp, event_type AS city, value AS demand FROM events")
def p3(spark, sf):
    return clean.project_rename_keep(_t(spark, sf, "events"), ["ts", "event_type", "value", "local_time"],
                                     {"ts": "timestamp", "event_type": "city", "value": "demand"})


def _wide(spark, sf):
    h = fx.demand_hourly(spark, sf)
    cities = sorted(r[0] for r in h.select("city").distinct().collect())   # a handful of series names
    return h.groupBy("timestamp").pivot("city", cities).agg(F.max("demand"))


_LONG_SQL = ("SELECT t.timestamp, c.city, h.demand FROM (SELECT DISTINCT timestamp FROM demand_hourly) t "
             "CROSS JOIN (SELECT DISTINCT city FROM demand_hourly) c "
             "LEFT JOIN demand_hourly h ON h.timestamp = t.timestamp AND h.city = c.city")


@query("P4_melt_wide_to_long", _LONG_SQL, (H,))
def p4(spark, sf):
    return clean.melt_wide_to_long(_wide(spark, sf), "timestamp", "city", "demand")


@query("P5_drop_null_demand", f"SELECT * FROM ({_LONG_SQL}) WHERE demand IS NOT NULL", (H,))
def p5(spark, sf):
    return clean.drop_null(clean.melt_wide_to_long(_wide(spark, sf)), ["demand"])


@query("P6_filter_date_range",
       "SELECT * FROM demand_hourly WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' "
       "AND timestamp <= TIMESTAMP '2024-01-15 00:00:00'", (H,))
def p6(spark, sf):
    return clean.filter_date_range(fx.demand_hourly(spark, sf), "2024-01-08", "2024-01-15")


@query("P7_clamp_date_range",
       "SELECT TIMESTAMP '2023-12-25 00:00:00' AS requested_start, TIMESTAMP '2024-01-10 00:00:00' AS requested_end, "
       "min(timestamp) AS data_start, max(timestamp) AS data_end, "
       "NOT (TIMESTAMP '2024-01-10 00:00:00' < min(timestamp) OR TIMESTAMP '2023-12-25 00:00:00' > max(timestamp)) AS overlaps, "
       "greatest(TIMESTAMP '2023-12-25 00:00:00', min(timestamp)) AS adjusted_start, "
       "least(TIMESTAMP '2024-01-10 00:00:00', max(timestamp)) AS adjusted_end FROM demand_hourly", (H,))
def p7(spark, sf):
    return clean.clamp_date_range(fx.demand_hourly(spark, sf), "2023-12-25", "2024-01-10")


@query("P8_filter_city", "SELECT * FROM demand_hourly WHERE city = 'purchase'", (H,))
def p8(spark, sf):
    return clean.filter_city(fx.demand_hourly(spark, sf), "purchase")


def _z_sql(view, cols, out="anomaly_z"):
    st = ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in cols)
    cond = " OR ".join(f"coalesce(abs(({c} - mu_{c}) / sd_{c}) > 3, false)" for c in cols)
    return f"SELECT b.*, ({cond}) AS {out} FROM {view} b, (SELECT {st} FROM {view}) s"


def _iqr_sql(view, cols, out="anomaly_iqr"):
    st = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    cond = " OR ".join(f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false)"
                       for c in cols)
    return f"SELECT b.*, ({cond}) AS {out} FROM {view} b, (SELECT {st} FROM {view}) s"


_MD_COLS = "city, timestamp, demand, temperature, humidity, wind_speed, pressure"


@query("P9_mask_rows", f"SELECT {_MD_COLS} FROM ({_z_sql(MD, N5)}) WHERE NOT anomaly_z", (MD,))
def p9(spark, sf):
    z = anomaly.anomaly_zscore(fx.merged_daily(spark, sf), N5)
    return clean.mask_rows(z, "anomaly_z").drop("anomaly_z")


@query("P10_align_features",
       f"SELECT city, timestamp, {s6('sin(2 * pi() * hour(timestamp) / 24.0)')} AS hour_sin, "
       f"{s6('cos(2 * pi() * hour(timestamp) / 24.0)')} AS hour_cos, "
       "CAST(isodow(timestamp) - 1 >= 5 AS DOUBLE) AS is_weekend, CAST(0 AS DOUBLE) AS temperature_binned, demand "
       "FROM demand_hourly", (H,))
def p10(spark, sf):
    h = fx.demand_hourly(spark, sf)
    feats = h.select("*", r6(cal.cyclical(F.hour("timestamp"), 24, "sin")).alias("hour_sin"),
                     r6(cal.cyclical(F.hour("timestamp"), 24, "cos")).alias("hour_cos"),
                     cal.is_weekend(cal.dayofweek_mon0("timestamp")).alias("is_weekend"),
                     F.lit("extra").alias("unused"))
    return clean.align_features(feats, ["hour_sin", "hour_cos", "is_weekend", "temperature_binned", "demand"],
                                keep=["city", "timestamp"])


_PCT_SQL = ("SELECT city, timestamp, demand, "
            "coalesce(CASE WHEN l24 = 0 THEN (CASE WHEN demand > 0 THEN 'inf'::DOUBLE WHEN demand < 0 THEN '-inf'::DOUBLE END) "
            "ELSE demand / l24 - 1 END, 0.0) AS demand_pct_change_1d, "
            "coalesce(CASE WHEN l168 = 0 THEN (CASE WHEN demand > 0 THEN 'inf'::DOUBLE WHEN demand < 0 THEN '-inf'::DOUBLE END) "
            "ELSE demand / l168 - 1 END, 0.0) AS demand_pct_change_1w FROM ("
            "SELECT *, lag(demand, 24) OVER w AS l24, lag(demand, 168) OVER w AS l168 FROM demand_hourly "
            "WINDOW w AS (PARTITION BY city ORDER BY timestamp))")


@query("P11_inf_to_null",
       f"SELECT city, timestamp, demand, CASE WHEN isinf(demand_pct_change_1d) OR isnan(demand_pct_change_1d) THEN NULL "
       f"ELSE {s6('demand_pct_change_1d')} END AS demand_pct_change_1d, "
       f"CASE WHEN isinf(demand_pct_change_1w) OR isnan(demand_pct_change_1w) THEN NULL "
       f"ELSE {s6('demand_pct_change_1w')} END AS demand_pct_change_1w FROM ({_PCT_SQL})", (H,))
def p11(spark, sf):
    g = series.pct_change_features(fx.demand_hourly(spark, sf))
    out = clean.inf_to_null(g, ["demand_pct_change_1d", "demand_pct_change_1w"])
    return out.select("city", "timestamp", "demand", r6("demand_pct_change_1d").alias("demand_pct_change_1d"),
                      r6("demand_pct_change_1w").alias("demand_pct_change_1w"))


@query("P12_select_by_dtype", f"SELECT {', '.join(N5)}, city FROM merged_daily", (MD,))
def p12(spark, sf):
    df = fx.merged_daily(spark, sf)
    num = clean.select_by_dtype(df, "numeric")
    txt = clean.select_by_dtype(df, "string")
    return df.select(*num, *txt)


@query("P13_find_time_columns", "SELECT *, CAST(o_orderdate AS TIMESTAMP) AS parsed_time FROM orders")
def p13(spark, sf):
    return clean.parse_first_time_column(_t(spark, sf, "orders"))


@query("P14_drop_columns", "SELECT * EXCLUDE (props) FROM events")
def p14(spark, sf):
    return _t(spark, sf, "events").drop("props")


@query("P16_filter_nonnull_row",
       "SELECT * FROM (SELECT *, lag(demand, 24) OVER w AS demand_lag_24h, lag(demand, 48) OVER w AS demand_lag_48h, "
       "lag(demand, 168) OVER w AS demand_lag_168h FROM demand_hourly WINDOW w AS (PARTITION BY city ORDER BY timestamp)) "
       "WHERE demand_lag_24h IS NOT NULL AND demand_lag_48h IS NOT NULL AND demand_lag_168h IS NOT NULL", (H,))
def p16(spark, sf):
    lags = series.lag_features(fx.demand_hourly(spark, sf))
    return clean.drop_null(lags, ["demand_lag_24h", "demand_lag_48h", "demand_lag_168h"])


@query("P17_cluster_feature_fallback",
       f"SELECT city, timestamp, demand, {s6('temperature_scaled')} AS temperature_scaled, "
       f"{s6('sin(2 * pi() * month(timestamp) / 12.0)')} AS month_sin, {s6('cos(2 * pi() * month(timestamp) / 12.0)')} AS month_cos "
       f"FROM (SELECT *, (temperature - min(temperature) OVER ()) / nullif(max(temperature) OVER () - min(temperature) OVER (), 0) "
       "AS temperature_scaled FROM merged_daily)", (MD,))
def p17(spark, sf):
    df = scale.minmax_scale(fx.merged_daily(spark, sf), ["temperature"])
    df = df.withColumn("month", F.month("timestamp"))
    df = cal.cyclical_encode(df, {"month": 12})
    # The default clustering columns and those that fill gaps.
    feats = clean.choose_features(df, default=("demand", "temperature_scaled", "hour_sin", "hour_cos"),
                                  extra=("day_sin", "day_cos", "month_sin", "month_cos", "is_weekend"))
    return df.select("city", "timestamp", *[F.col(c) if c == "demand" else r6(c).alias(c) for c in feats])


# ============================================================== J: joins

@query("J1_join_demand_weather", "SELECT * FROM merged_daily", (MD,))
def j1(spark, sf):
    return clean.join_demand_weather(fx.demand_daily(spark, sf), fx.weather_daily(spark, sf))


_DUP_KEYS = {"orders": "o_custkey, o_orderdate", "lineitem": "l_suppkey, l_shipdate"}


@query("J1_duplicate_keys",
       " UNION ALL ".join(
           f"SELECT '{side}' AS side, {k.split(', ')[0]} AS who, {k.split(', ')[1]} AS day, count(*) AS count FROM {t} "
           f"GROUP BY {k} HAVING count(*) > 1" for side, (t, k) in zip(("left", "right"), _DUP_KEYS.items())))
def j1_duplicates(spark, sf):
    sides = [_t(spark, sf, t).select(*[F.col(c).alias(n) for c, n in zip(k.split(", "), ("who", "day"))])
             for t, k in _DUP_KEYS.items()]
    return clean.duplicate_report(*sides, keys=("who", "day"))


@query("J2_union_sources",
       "SELECT 'nation' AS grain, * FROM demand_daily UNION ALL SELECT 'region' AS grain, * FROM demand_region",
       ("demand_daily", "demand_region"))
def j2(spark, sf):
    a = fx.demand_daily(spark, sf).select(F.lit("nation").alias("grain"), "*")
    b = fx.demand_daily(spark, sf, "region").select(F.lit("region").alias("grain"), "*")
    return clean.union_sources(a, b)


def _share_sql(where, name):
    return (f"SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) * 1.0 / sum(count(*)) OVER () AS {name} "
            f"FROM events WHERE {where} GROUP BY 1")


_CLICK_SHARE = _share_sql("event_type = 'click'", "click")
_PURCHASE_SHARE = _share_sql("event_type = 'purchase'", "purchase")


@query("J3_outer_compare",
       f"SELECT coalesce(a.hour, b.hour) AS hour, {s6('coalesce(a.click, 0.0)')} AS click, "
       f"{s6('coalesce(b.purchase, 0.0)')} AS purchase FROM ({_CLICK_SHARE}) a "
       f"FULL OUTER JOIN ({_PURCHASE_SHARE}) b ON a.hour = b.hour")
def j3(spark, sf):
    from ..operators.rollup import value_share
    ev = _t(spark, sf, "events").withColumn("hour", F.hour("ts"))
    a = value_share(ev.where(F.col("event_type") == "click"), "hour").withColumnRenamed("share", "click")
    b = value_share(ev.where(F.col("event_type") == "purchase"), "hour").withColumnRenamed("share", "purchase")
    out = clean.outer_compare(a, b, "hour", "click", "purchase")
    return out.select("hour", r6("click").alias("click"), r6("purchase").alias("purchase"))


def _naive_sql(n, view="demand_hourly", test_only=True):
    where = "WHERE rn >= floor(cnt * CAST(0.8 AS DOUBLE))" if test_only else ""
    return (f"SELECT city, timestamp, demand AS actual, predicted FROM ("
            f"SELECT *, lag(demand, {n}) OVER w AS predicted, row_number() OVER w - 1 AS rn, "
            f"count(*) OVER (PARTITION BY city) AS cnt FROM {view} "
            f"WINDOW w AS (PARTITION BY city ORDER BY timestamp)) {where} "
            f"{'AND' if test_only else 'WHERE'} predicted IS NOT NULL")


@query("J4_align_forecast",
       "SELECT city, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS date, actual, predicted, "
       f"{s6('greatest(0.0, predicted * 0.9)')} AS lower, {s6('predicted * 1.1')} AS upper "
       f"FROM ({_naive_sql(24)})", (H,))
def j4(spark, sf):
    from ..operators import models
    p = models.naive_forecast(fx.demand_hourly(spark, sf))
    lo, hi = models.confidence_bounds(F.col("predicted"))
    return p.select("city", cal.format_timestamp("timestamp").alias("date"), "actual", "predicted",
                    r6(lo).alias("lower"), r6(hi).alias("upper"))


@query("J5_align_tail",
       f"SELECT a.city, a.timestamp, a.actual, a.predicted AS pred_day, b.predicted AS pred_week "
       f"FROM ({_naive_sql(24)}) a JOIN ({_naive_sql(168)}) b ON a.city = b.city AND a.timestamp = b.timestamp", (H,))
def j5(spark, sf):
    from ..operators import models
    h = fx.demand_hourly(spark, sf)
    a = models.naive_forecast(h, horizon=24).withColumnRenamed("predicted", "pred_day")
    b = models.naive_forecast(h, horizon=168).select("city", "timestamp", F.col("predicted").alias("pred_week"))
    return a.join(b, ["city", "timestamp"], "inner")


@query("J6_attach_scalar_stats",
       f"SELECT city, timestamp, demand, min(demand) OVER () AS demand_min, max(demand) OVER () AS demand_max, "
       f"{s6('avg(demand) OVER ()')} AS demand_mean FROM merged_daily", (MD,))
def j6(spark, sf):
    df = fx.merged_daily(spark, sf).select("city", "timestamp", "demand")
    out = clean.attach_scalar_stats(df, [F.min("demand").alias("demand_min"), F.max("demand").alias("demand_max"),
                                         F.avg("demand").alias("demand_mean")])
    return out.withColumn("demand_mean", r6("demand_mean"))


@query("J7_attach_group_stats",
       "SELECT city, timestamp, demand, median(demand) OVER (PARTITION BY city) AS city_median FROM merged_daily",
       (MD,))
def j7(spark, sf):
    df = fx.merged_daily(spark, sf).select("city", "timestamp", "demand")
    return clean.attach_group_quantiles(df, "city", {"city_median": ("demand", 0.5)})


# ============================================================== M: missing values

def _cols_sql(exprs):
    return ", ".join(exprs)


@query("M1_impute_group_median",
       "SELECT city, timestamp, demand, " +
       _cols_sql(f"coalesce({c}, median({c}) OVER (PARTITION BY city)) AS {c}" for c in W4) +
       " FROM demand_weather_gaps", (GAP,))
def m1(spark, sf):
    return clean.impute_group_median(fx.materialize(fx.demand_weather_gaps(spark, sf)), W4)


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BF = "first_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("M2_ffill", "SELECT city, timestamp, demand, " + _cols_sql(f"{_FF.format(c=c)} AS {c}" for c in W4) +
       " FROM demand_weather_gaps", (GAP,))
def m2(spark, sf):
    return clean.ffill(fx.materialize(fx.demand_weather_gaps(spark, sf)), W4)


@query("M3_bfill", "SELECT city, timestamp, demand, " + _cols_sql(f"{_BF.format(c=c)} AS {c}" for c in W4) +
       " FROM demand_weather_gaps", (GAP,))
def m3(spark, sf):
    return clean.bfill(fx.materialize(fx.demand_weather_gaps(spark, sf)), W4)


@query("M4_impute_chain",
       "SELECT city, timestamp, demand, " +
       _cols_sql(f"coalesce({_FF.format(c=c)}, {_BF.format(c=c)}, (SELECT median({c}) FROM demand_weather_gaps)) AS {c}"
                 for c in W4) + " FROM demand_weather_gaps", (GAP,))
def m4(spark, sf):
    return clean.impute_chain(fx.materialize(fx.demand_weather_gaps(spark, sf)), W4)


@query("M5_impute_mean",
       "SELECT city, timestamp, demand, " +
       _cols_sql(s6(f"coalesce({c}, avg({c}) OVER ())") + f" AS {c}" for c in W4) + " FROM demand_weather_gaps",
       (GAP,))
def m5(spark, sf):
    out = clean.impute_mean(fx.materialize(fx.demand_weather_gaps(spark, sf)), W4)
    return out.select("city", "timestamp", "demand", *[r6(c).alias(c) for c in W4])


_SPLIT_SQL = ("SELECT *, CASE WHEN row_number() OVER (PARTITION BY city ORDER BY timestamp) - 1 < "
              "floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM {v}")


@query("M6_impute_train_median",
       f"WITH s AS ({_SPLIT_SQL.format(v='demand_weather_gaps')}), "
       "m AS (SELECT " + _cols_sql(f"median({c}) AS m_{c}" for c in W4) + " FROM s WHERE split = 'train') "
       "SELECT city, timestamp, split, demand, " + _cols_sql(f"coalesce({c}, m_{c}) AS {c}" for c in W4) +
       " FROM s, m", (GAP,))
def m6(spark, sf):
    from ..operators.sample import split_chronological
    s = split_chronological(fx.materialize(fx.demand_weather_gaps(spark, sf)))
    tr, te = clean.impute_train_median(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), W4)
    return tr.unionByName(te).select("city", "timestamp", "split", "demand", *W4)


@query("M7_impute_zero",
       "SELECT city, timestamp, coalesce(demand - lag(demand, 24) OVER w, 0.0) AS demand_diff_1d "
       "FROM demand_hourly WINDOW w AS (PARTITION BY city ORDER BY timestamp)", (H,))
def m7(spark, sf):
    d = series.diff_features(fx.demand_hourly(spark, sf), (24,), names=("1d",))
    return d.select("city", "timestamp", clean.impute_zero("demand_diff_1d", 0.0).alias("demand_diff_1d"))


@query("M8_missing_profile", _profile_sql(GAP, GAP_TYPES, True), (GAP,))
def m8(spark, sf):
    return clean.missing_profile(fx.demand_weather_gaps(spark, sf), only_missing=True)


# ============================================================== E: date / math / string scalars

_CAL_SQL = ("CAST(hour(timestamp) AS INTEGER) AS hour, CAST(day(timestamp) AS INTEGER) AS day, "
            "CAST(month(timestamp) AS INTEGER) AS month, CAST(year(timestamp) AS INTEGER) AS year, "
            "CAST(quarter(timestamp) AS INTEGER) AS quarter, CAST(isodow(timestamp) - 1 AS INTEGER) AS dayofweek, "
            "CAST(dayofyear(timestamp) AS INTEGER) AS dayofyear, CAST(weekofyear(timestamp) AS INTEGER) AS weekofyear")


@query("E1_calendar_parts", f"SELECT *, {_CAL_SQL} FROM demand_hourly", (H,))
def e1(spark, sf):
    return cal.calendar_parts(fx.demand_hourly(spark, sf))


@query("E2_season",
       "SELECT city, timestamp, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' "
       "WHEN month(timestamp) IN (3, 4, 5) THEN 'spring' WHEN month(timestamp) IN (6, 7, 8) THEN 'summer' "
       "ELSE 'autumn' END AS season FROM merged_daily", (MD,))
def e2(spark, sf):
    return fx.merged_daily(spark, sf).select("city", "timestamp", cal.season(F.month("timestamp")).alias("season"))


def _cyc_sql(part_expr, name, period):
    return (f"{s6(f'sin(2 * pi() * {part_expr} / {float(period)})')} AS {name}_sin, "
            f"{s6(f'cos(2 * pi() * {part_expr} / {float(period)})')} AS {name}_cos")


@query("E3_cyclical_encode",
       "SELECT city, timestamp, " + ", ".join([
           _cyc_sql("hour(timestamp)", "hour", 24), _cyc_sql("day(timestamp)", "day", 31),
           _cyc_sql("month(timestamp)", "month", 12), _cyc_sql("(isodow(timestamp) - 1)", "dayofweek", 7)]) +
       " FROM demand_hourly", (H,))
def e3(spark, sf):
    c = cal.cyclical_encode(cal.calendar_parts(fx.demand_hourly(spark, sf)))
    names = [f"{p}_{f}" for p in cal.CYCLE_PERIODS for f in ("sin", "cos")]
    return c.select("city", "timestamp", *[r6(n).alias(n) for n in names])


@query("E4_is_weekend",
       "SELECT city, timestamp, CAST(isodow(timestamp) - 1 >= 5 AS INTEGER) AS is_weekend FROM demand_hourly", (H,))
def e4(spark, sf):
    h = fx.demand_hourly(spark, sf)
    return h.select("city", "timestamp", cal.is_weekend(cal.dayofweek_mon0("timestamp")).alias("is_weekend"))


@query("E5_day_part_onehot",
       "SELECT city, timestamp, CAST(hour(timestamp) >= 5 AND hour(timestamp) < 12 AS INTEGER) AS day_part_0, "
       "CAST(hour(timestamp) >= 12 AND hour(timestamp) < 17 AS INTEGER) AS day_part_1, "
       "CAST(hour(timestamp) >= 17 AND hour(timestamp) < 22 AS INTEGER) AS day_part_2, "
       "CAST(hour(timestamp) >= 22 OR hour(timestamp) < 5 AS INTEGER) AS day_part_3 FROM demand_hourly", (H,))
def e5(spark, sf):
    h = fx.demand_hourly(spark, sf)
    return h.select("city", "timestamp", *cal.day_part_onehot(F.hour("timestamp")))


# Fixed values for the registered holiday query (flag supplied as data).
HOLIDAY_DATES = ["2024-01-01", "2024-01-15"]


@query("E6_holiday_neighbours",
       "SELECT city, timestamp, is_holiday, coalesce(lead(is_holiday, 24) OVER w, 0) AS is_day_before_holiday, "
       "coalesce(lag(is_holiday, 24) OVER w, 0) AS is_day_after_holiday FROM ("
       "SELECT *, CAST(CAST(timestamp AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS INTEGER) AS is_holiday "
       "FROM demand_hourly) WINDOW w AS (PARTITION BY city ORDER BY timestamp)", (H,))
def e6(spark, sf):
    h = fx.demand_hourly(spark, sf)
    h = h.withColumn("is_holiday", F.to_date("timestamp").isin(*[F.lit(d).cast("date") for d in HOLIDAY_DATES])
                     .cast("int"))
    return series.holiday_neighbours(h).select("city", "timestamp", "is_holiday", "is_day_before_holiday",
                                               "is_day_after_holiday")


def _fourier_sql():
    out = []
    for p in cal.FOURIER_PERIODS:
        for k in cal.FOURIER_HARMONICS:
            arg = f"2 * pi() * {k} * rn / {float(p)}"
            out.append(f"{s6(f'sin({arg})')} AS fourier_sin_{p}_{k}")
            out.append(f"{s6(f'cos({arg})')} AS fourier_cos_{p}_{k}")
    return ", ".join(out)


@query("E7_fourier_terms",
       f"SELECT city, timestamp, {_fourier_sql()} FROM (SELECT *, row_number() OVER "
       "(PARTITION BY city ORDER BY timestamp) - 1 AS rn FROM demand_hourly)", (H,))
def e7(spark, sf):
    f = series.fourier_features(fx.demand_hourly(spark, sf))
    names = [c for c in f.columns if c.startswith("fourier_")]
    return f.select("city", "timestamp", *[r6(n).alias(n) for n in names])


@query("E8_truncate_date",
       "SELECT city, timestamp, CAST(timestamp AS DATE) AS date, CAST(weekofyear(timestamp) AS INTEGER) AS week, "
       "CAST(isoyear(timestamp) AS INTEGER) AS iso_year FROM merged_daily", (MD,))
def e8(spark, sf):
    return cal.truncate_date(fx.merged_daily(spark, sf).select("city", "timestamp"))


@query("E9_format_timestamp",
       "SELECT city, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(timestamp, '%Y-%m-%d') AS date_text "
       "FROM demand_hourly", (H,))
def e9(spark, sf):
    h = fx.demand_hourly(spark, sf)
    return h.select("city", cal.format_timestamp("timestamp").alias("ts_text"),
                    cal.format_timestamp("timestamp", False).alias("date_text"))


def _scaled_sql(cols, view="merged_daily"):
    st = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    sc = ", ".join(f"({c} - mn_{c}) / (mx_{c} - mn_{c}) AS {c}_scaled" for c in cols)
    return f"SELECT b.*, {sc} FROM {view} b, (SELECT {st} FROM {view}) s"


@query("E10_poly_terms",
       f"SELECT city, timestamp, {s6('power(temperature_scaled, 2)')} AS temperature_scaled_squared, "
       f"{s6('power(temperature_scaled, 3)')} AS temperature_scaled_cubed FROM ({_scaled_sql(['temperature'])})",
       (MD,))
def e10(spark, sf):
    s = scale.minmax_scale(fx.merged_daily(spark, sf), ["temperature"])
    p = s.select("city", "timestamp", *cal.poly_terms("temperature_scaled"))
    return p.select("city", "timestamp", r6("temperature_scaled_squared").alias("temperature_scaled_squared"),
                    r6("temperature_scaled_cubed").alias("temperature_scaled_cubed"))


def _pairs(cols):
    import itertools
    return list(itertools.combinations(cols, 2))


@query("E11_pairwise_interactions",
       "SELECT city, timestamp, " + ", ".join(f"{s6(f'{a}_scaled * {b}_scaled')} AS {a}_{b}_interaction"
                                              for a, b in _pairs(W4)) + f" FROM ({_scaled_sql(W4)})", (MD,))
def e11(spark, sf):
    s = scale.minmax_scale(fx.merged_daily(spark, sf), W4)
    inter = cal.pairwise_interactions([f"{c}_scaled" for c in W4], name=lambda a, b: f"{a[:-7]}_{b[:-7]}")
    out = s.select("city", "timestamp", *inter)
    return out.select("city", "timestamp", *[r6(c).alias(c) for c in out.columns[2:]])


@query("E12_concat_key",
       "SELECT event_id, concat_ws('_', event_type, CAST(hour(ts) AS VARCHAR), CAST(isodow(ts) - 1 AS VARCHAR)) AS strata "
       "FROM events")
def e12(spark, sf):
    ev = _t(spark, sf, "events").withColumn("hour", F.hour("ts")).withColumn("dayofweek", F.weekday("ts"))
    return ev.select("event_id", cal.concat_key(["event_type", "hour", "dayofweek"]).alias("strata"))


@query("E13_clip",
       f"SELECT city, timestamp, {s6('greatest(-3.0, least(3.0, (demand - mu) / sd))')} AS demand_z_clipped "
       "FROM merged_daily, (SELECT avg(demand) AS mu, stddev_pop(demand) AS sd FROM merged_daily)", (MD,))
def e13(spark, sf):
    s = scale.standardize(fx.merged_daily(spark, sf), ["demand"])
    return s.select("city", "timestamp", r6(cal.clip("demand_std")).alias("demand_z_clipped"))


@query("E14_round_report",
       "SELECT city, CAST(timestamp AS DATE) AS date, round(avg(demand), 2) AS avg_demand, "
       "round(max(demand), 2) AS max_demand, round(min(demand), 2) AS min_demand, "
       "round(avg(temperature), 2) AS avg_temp FROM merged_region GROUP BY 1, 2", (MR,))
def e14(spark, sf):
    from ..operators.rollup import daily_summary
    d = daily_summary(fx.merged_region(spark, sf))
    return d.select("city", "date", *[cal.round_report(c).alias(c) for c in
                                      ["avg_demand", "max_demand", "min_demand", "avg_temp"]])


# ============================================================== F: scaling and binning

@query("F1_minmax_scale",
       "SELECT city, timestamp, " + ", ".join(f"{s6(f'{c}_scaled')} AS {c}_scaled" for c in N5) +
       f" FROM ({_scaled_sql(N5)})", (MD,))
def f1(spark, sf):
    s = scale.minmax_scale(fx.merged_daily(spark, sf), N5)
    return s.select("city", "timestamp", *[r6(f"{c}_scaled").alias(f"{c}_scaled") for c in N5])


_FIT_CUT = "1999-01-01"


@query("F2_minmax_fit_transform",
       "SELECT city, timestamp, " +
       ", ".join(s6(f"({c} - mn_{c}) / CASE WHEN mx_{c} = mn_{c} THEN 1.0 ELSE mx_{c} - mn_{c} END") + f" AS {c}_scaled"
                 for c in N5) +
       " FROM merged_daily, (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in N5) +
       f" FROM merged_daily WHERE timestamp < TIMESTAMP '{_FIT_CUT} 00:00:00')", (MD,))
def f2(spark, sf):
    md = fx.merged_daily(spark, sf)
    fit = scale.minmax_stats(md.where(F.col("timestamp") < F.lit(_FIT_CUT).cast("timestamp_ntz")), N5)
    s = scale.minmax_transform(md, fit, N5)
    return s.select("city", "timestamp", *[r6(f"{c}_scaled").alias(f"{c}_scaled") for c in N5])


@query("F3_standardize",
       "SELECT city, timestamp, " +
       ", ".join(s6(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END") + f" AS {c}_std" for c in N5) +
       " FROM merged_daily, (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in N5) +
       " FROM merged_daily)", (MD,))
def f3(spark, sf):
    s = scale.standardize(fx.merged_daily(spark, sf), N5)
    return s.select("city", "timestamp", *[r6(f"{c}_std").alias(f"{c}_std") for c in N5])


@query("F4_inverse_scale",
       "SELECT city, timestamp, demand, " + s6("((demand - mn) / (mx - mn)) * (mx - mn) + mn") +
       " AS demand_scaled_inv FROM merged_daily, (SELECT min(demand) AS mn, max(demand) AS mx FROM merged_daily)",
       (MD,))
def f4(spark, sf):
    md = fx.merged_daily(spark, sf)
    fit = scale.minmax_stats(md, ["demand"])
    s = scale.minmax_transform(md, fit, ["demand"])
    inv = scale.inverse_scale(s, fit, {"demand_scaled": "demand"})
    return inv.select("city", "timestamp", "demand", r6("demand_scaled_inv").alias("demand_scaled_inv"))


def _qbin_sql(cols, view="merged_daily"):
    st = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e_{c}"
                   for c in cols)
    bins = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(greatest(len(list_filter(e_{c}, lambda e: e < {c})) - 1, 0) "
                     f"AS INTEGER) END AS {c}_binned" for c in cols)
    return f"SELECT city, timestamp, {bins} FROM {view}, (SELECT {st} FROM {view})"


@query("F5_quantile_bin", _qbin_sql(W4), (MD,))
def f5(spark, sf):
    b = scale.quantile_bin(fx.merged_daily(spark, sf), W4)
    return b.select("city", "timestamp", *[F.col(f"{c}_binned").cast("int").alias(f"{c}_binned") for c in W4])


def _fixed_bin_sql(c):
    e = scale.FIXED_BIN_EDGES
    cases = " ".join(f"WHEN {c} > {e[i]} AND {c} <= {e[i + 1]} THEN CAST({i} AS DOUBLE)" for i in range(len(e) - 1))
    return f"CASE {cases} ELSE CAST(0 AS DOUBLE) END"


@query("F6_fixed_bin",
       f"SELECT city, timestamp, temperature, {_fixed_bin_sql('temperature')} AS temperature_binned FROM merged_daily",
       (MD,))
def f6(spark, sf):
    md = fx.merged_daily(spark, sf)
    return md.select("city", "timestamp", "temperature", scale.fixed_bin("temperature").alias("temperature_binned"))


@query("F7_histogram",
       "SELECT bin, anomaly_z, " + s6("mn + bin * (mx - mn) / 50.0") + " AS bin_lo, " +
       s6("mn + (bin + 1) * (mx - mn) / 50.0") + " AS bin_hi, count(*) AS n FROM ("
       "SELECT CAST(least(coalesce(floor((demand - mn) / ((mx - mn) / 50.0)), 0), 49) AS INTEGER) AS bin, "
       f"CAST(anomaly_z AS INTEGER) AS anomaly_z, mn, mx FROM ({_z_sql(MD, ['demand'])}) z, "
       "(SELECT min(demand) AS mn, max(demand) AS mx FROM merged_daily) s WHERE demand IS NOT NULL) "
       "GROUP BY bin, anomaly_z, mn, mx", (MD,))
def f7(spark, sf):
    z = anomaly.anomaly_zscore(fx.merged_daily(spark, sf), ["demand"])
    h = scale.histogram(z, "demand", 50, split="anomaly_z")
    return h.select("bin", "anomaly_z", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


def _box_sql(cols):
    long = " UNION ALL ".join(f"SELECT city, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM merged_daily "
                              f"WHERE {c} IS NOT NULL" for c in cols)
    return (f"WITH l AS ({long}), q AS (SELECT city, \"column\", quantile_cont(v, 0.25) AS q1, median(v) AS median, "
            "quantile_cont(v, 0.75) AS q3, min(v) AS min, max(v) AS max, count(v) AS n FROM l GROUP BY 1, 2), "
            "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q), "
            "i AS (SELECT l.city, l.\"column\", min(v) AS whisker_lo, max(v) AS whisker_hi, count(v) AS n_inside "
            "FROM l JOIN f ON l.city = f.city AND l.\"column\" = f.\"column\" WHERE v >= lo_fence AND v <= hi_fence "
            "GROUP BY 1, 2) "
            f"SELECT f.city, f.\"column\", n, min, {s6('q1')} AS q1, {s6('median')} AS median, {s6('q3')} AS q3, max, "
            f"{s6('lo_fence')} AS lo_fence, {s6('hi_fence')} AS hi_fence, whisker_lo, whisker_hi, "
            "n - coalesce(n_inside, 0) AS n_outliers FROM f LEFT JOIN i ON f.city = i.city AND f.\"column\" = i.\"column\"")


@query("F8_box_stats", _box_sql(N5), (MD,))
def f8(spark, sf):
    b = scale.box_stats(fx.merged_daily(spark, sf), N5)
    return b.select("city", "column", "n", "min", r6("q1").alias("q1"), r6("median").alias("median"),
                    r6("q3").alias("q3"), "max", r6("lo_fence").alias("lo_fence"), r6("hi_fence").alias("hi_fence"),
                    "whisker_lo", "whisker_hi", "n_outliers")
