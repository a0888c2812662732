"""Unit tests on small hand-made frames (FIXTURES.md part C): edge cases the
driver tables do not contain."""

import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from loadstats.functions import calendar as cal
from loadstats.operators import clean, frames, scale, series
from loadstats.sources import readers

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=i) for i in range(n)]


def test_fixed_bin_edges(spark):
    vals = [0.0, 0.5, 40.0, 40.5, 100.0, 120.0, 121.0, -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "temperature double")
    got = [r[0] for r in df.select(scale.fixed_bin("temperature")).collect()]
    # right-closed (0,40] -> 0 ... (100,120] -> 7; outside -> 0 (reference parity)
    assert got == [0.0, 0.0, 0.0, 1.0, 6.0, 7.0, 0.0, 0.0]


def test_pct_change_zero_base(spark):
    ts = hours(4)
    df = spark.createDataFrame([("a", ts[0], 0.0), ("a", ts[1], 0.0), ("a", ts[2], 5.0), ("a", ts[3], 10.0)],
                               "city string, timestamp timestamp_ntz, demand double")
    out = series.pct_change_features(df, ns=(1, 2), names=("1", "2")).orderBy("timestamp").collect()
    assert [r["demand_pct_change_1"] for r in out] == [0.0, 0.0, math.inf, 1.0]
    assert [r["demand_pct_change_2"] for r in out] == [0.0, 0.0, math.inf, math.inf]


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(5)], "x double, c double")
    mm = scale.minmax_scale(df, ["c"]).select("c_scaled").distinct().collect()
    assert [r[0] for r in mm] == [None]                       # F1: NULL
    ft = scale.minmax_fit_transform(df, ["c"]).select("c_scaled").distinct().collect()
    assert [r[0] for r in ft] == [0.0]                        # F2: 0
    st = scale.standardize(df, ["c", "x"]).orderBy("x").collect()
    assert {r["c_std"] for r in st} == {0.0}                  # F3: divided by 1
    assert abs(st[0]["x_std"] + math.sqrt(2.0)) < 1e-12       # population std


def test_group_median_all_null_city_stays_null(spark):
    ts = hours(3)
    rows = [("a", ts[0], 1.0), ("a", ts[1], None), ("a", ts[2], 3.0),
            ("b", ts[0], None), ("b", ts[1], None)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, temperature double")
    out = {(r.city, r.timestamp): r.temperature for r in clean.impute_group_median(df, ["temperature"]).collect()}
    assert out[("a", ts[1])] == 2.0
    assert out[("b", ts[0])] is None and out[("b", ts[1])] is None


def test_iso_week_53_and_week_1(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3),), (dt.datetime(2021, 1, 4),)], "timestamp timestamp_ntz")
    out = cal.truncate_date(df).orderBy("timestamp").collect()
    assert [(r.iso_year, r.week) for r in out] == [(2020, 53), (2021, 1)]


def test_duplicate_keys_multiply_and_are_reported(spark):
    t = T0
    d = spark.createDataFrame([("a", t, 1.0), ("a", t, 2.0)], "city string, timestamp timestamp_ntz, demand double")
    w = spark.createDataFrame([("a", t, 10.0), ("a", t, 11.0)], "city string, timestamp timestamp_ntz, temperature double")
    assert clean.join_demand_weather(d, w).count() == 4
    assert clean.duplicate_keys(d).collect()[0]["count"] == 2


def test_interleaved_cities_and_long_lag(spark):
    ts = hours(200)
    rows = [(c, t, float(i if c == "a" else 1000 + i)) for i, t in enumerate(ts) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, demand double")
    out = series.lag_features(df, (168,), chunk_rows=64).where(F.col("demand_lag_168h").isNotNull())
    assert out.count() == 2 * 32
    assert out.where(F.col("demand") - F.col("demand_lag_168h") != 168).count() == 0


def test_quantile_bin_duplicate_edges(spark):
    vals = [1.0] * 8 + [2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r[0] for r in scale.quantile_bin(df, ["x"]).select("x_binned").collect()]
    # quantile edges repeat 1.0; duplicates are dropped and the tied lowest values share bin 0
    assert min(out) == 0 and out.count(0) == 8


def test_carry_both_matches_plain_windows(spark):
    ts = hours(30)
    rows = [("a", t, (float(i) if i % 4 == 0 else None)) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, v double")
    got = frames.carry_both(df, ["v"], chunk_rows=7).orderBy("timestamp").collect()
    vals = [r[2] for r in rows]
    last, ff = None, []
    for v in vals:
        last = v if v is not None else last
        ff.append(last)
    nxt, bf = None, []
    for v in reversed(vals):
        nxt = v if v is not None else nxt
        bf.append(nxt)
    bf.reverse()
    assert [r["v_ffill"] for r in got] == ff
    assert [r["v_bfill"] for r in got] == bf


def test_weather_json_arrays_city_from_file_name(spark, tmp_path):
    for city, temp in (("new_york", 40.0), ("austin", 80.0)):
        folder = tmp_path / f"city={city}"
        folder.mkdir()
        recs = [{"timestamp": "2024-01-01 00:00:00", "temperature": temp, "humidity": 0.5},
                {"timestamp": "2024-01-01 01:00:00", "temperature": temp + 1}]
        (folder / "weather.json").write_text(json.dumps(recs))
    df = readers.scan_weather_json(spark, f"{tmp_path}/city=*/*.json", multiline=True)
    got = {(r.city, r.temperature) for r in df.collect()}
    assert got == {("new_york", 40.0), ("new_york", 41.0), ("austin", 80.0), ("austin", 81.0)}
    assert df.where(F.col("humidity").isNull()).count() == 2          # missing fields become NULL


def test_nested_hourly_json_is_flattened(spark, tmp_path):
    obj = {"hourly": [{"time": 1704067200, "temperature": 1.5}, {"time": 1704070800, "temperature": 2.5}],
           "daily": [{"time": 1704067200, "temperature": 2.0}]}
    p = os.path.join(tmp_path, "nested.json")
    with open(p, "w") as f:
        json.dump(obj, f)
    raw = spark.read.option("multiLine", True).json(p)
    flat = readers.flatten_nested(raw, "hourly")
    ts = flat.select(cal.parse_timestamp(flat, ("time",)).alias("timestamp"), "temperature").orderBy("timestamp").collect()
    assert [r.temperature for r in ts] == [1.5, 2.5]
    assert ts[0].timestamp == dt.datetime(2024, 1, 1, 0, 0)


def test_canonical_city_whitespace(spark):
    df = spark.createDataFrame([("  New   York\t",), ("MIDDLE EAST",)], "c string")
    assert [r[0] for r in df.select(cal.canonical_city("c")).collect()] == ["new_york", "middle_east"]


def test_require_columns_rejects(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        readers.require_columns(df, ["a", "demand"])
    with pytest.raises(ValueError):
        readers.require_columns(df.where("a > 5"), ["a"])


def test_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    """Three files, one a batch = three micro-batches. Spark drops a row whose event time is
    below the watermark in force before the batch (max event time - 2 h of the
    batches so far): the 09:15 row in the third file is dropped, the 12:xx rows
    arriving late but inside the watermark still count."""
    import glob
    import shutil
    from loadstats.streaming import hourly
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    d = dt.datetime(2024, 1, 1)
    at = lambda h, m=0: d.replace(hour=h, minute=m)
    files = [[(1, at(10, 5), 1, "click", 1.0, "{}"), (2, at(13), 1, "click", 2.0, "{}")],
             [(3, at(12, 30), 1, "click", 4.0, "{}"), (4, at(13, 30), 1, "click", 3.0, "{}")],
             [(5, at(9, 15), 1, "click", 100.0, "{}"), (6, at(12, 45), 1, "click", 5.0, "{}")]]
    folder = str(tmp_path / "events")
    os.makedirs(folder + "/all")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{i}")
        dst = f"{folder}/all/f{i}.parquet"
        shutil.copy(glob.glob(f"{folder}/p{i}/*.parquet")[0], dst)
        os.utime(dst, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))   # stream order = file age
    out = {r.timestamp.hour: r.demand for r in hourly.run_hourly_demand(spark, folder + "/all", max_files=1).collect()}
    assert out == {10: 1.0, 12: 9.0, 13: 5.0}


def test_calendar_lag_survives_gaps(spark):
    ts = hours(60)
    keep = [t for i, t in enumerate(ts) if i not in (30, 31, 32)]          # a 3-hour gap
    df = spark.createDataFrame([("a", t, float(t.hour + 24 * (t.day - 1))) for t in keep],
                               "city string, timestamp timestamp_ntz, demand double")
    rows = series.lag_features(df, (24,), mode="calendar").orderBy("timestamp").collect()
    for r in rows:
        lag = r["demand_lag_24h"]
        if lag is not None:
            assert r["demand"] - lag == 24.0                               # exactly one day back in clock time
    gapped = {r.timestamp: r["demand_lag_24h"] for r in rows}
    assert gapped[ts[30 + 24]] is None                                     # 24 h earlier is missing


def test_parse_timestamp_prefers_local_time(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "2024-01-01 10:00:00")], "local_time string, utc_time string")
    assert df.select(cal.parse_timestamp(df)).first()[0] == dt.datetime(2024, 1, 1, 5)
    only_utc = df.drop("local_time")
    assert only_utc.select(cal.parse_timestamp(only_utc)).first()[0] == dt.datetime(2024, 1, 1, 10)


def test_ridge_matches_numpy(spark):
    import numpy as np
    from loadstats.operators import models
    rng = np.random.default_rng(0)
    a = rng.normal(100, 10, 200)
    b = a + rng.normal(0, 5, 200)
    y = 0.6 * a + 0.3 * b + rng.normal(0, 1, 200) + 7
    df = spark.createDataFrame([(float(x1), float(x2), float(t)) for x1, x2, t in zip(a, b, y)], "pa double, pb double, y double")
    fit = models.ridge_fit(df, ["pa", "pb"], "y", alpha=0.5)
    X = np.column_stack([a - a.mean(), b - b.mean()])
    coef = np.linalg.solve(X.T @ X + 0.5 * np.eye(2), X.T @ (y - y.mean()))
    assert np.allclose([fit["coef_a"], fit["coef_b"]], coef, rtol=1e-9)
    assert abs(fit["intercept"] - (y.mean() - coef @ [a.mean(), b.mean()])) < 1e-8


def test_rolling_origin_folds_partition_the_tail(spark):
    from loadstats.operators import models
    ts = hours(100)
    df = spark.createDataFrame([("a", t, 1.0) for t in ts], "city string, timestamp timestamp_ntz, demand double")
    counts = {r.fold: r["count"] for r in models.rolling_origin_folds(df).groupBy("fold").count().collect()}
    assert counts == {None: 50, 1: 10, 2: 10, 3: 10, 4: 10, 5: 10}


def test_load_sources_skips_missing_empty_and_incomplete(spark, tmp_path):
    good = str(tmp_path / "good")
    empty = str(tmp_path / "empty")
    partial = str(tmp_path / "partial")
    schema = "city string, timestamp timestamp_ntz, demand double"
    spark.createDataFrame([("a", T0, 1.0), ("b", T0, 2.0)], schema).write.parquet(good)
    spark.createDataFrame([], schema).write.parquet(empty)
    spark.createDataFrame([("a", T0)], "city string, timestamp timestamp_ntz").write.parquet(partial)
    notes = []
    out = readers.load_sources(spark, [good, str(tmp_path / "nope"), empty, partial, good],
                               ["city", "timestamp", "demand"], log=notes.append)
    assert out.count() == 4                                       # good twice, UNION ALL
    assert [n.split(": ")[1].split(" ")[0] for n in notes] == ["missing", "empty", "lacks"]


def test_scan_glob_reports_files_and_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"EIA930_BALANCE_{i}.csv").write_text("city,timestamp,demand\nx,2024-01-01 00:00:00,1.5\n")
    (tmp_path / "other.csv").write_text("city,timestamp,demand\ny,2024-01-01 00:00:00,9.0\n")
    df = readers.scan_glob(spark, f"{tmp_path}/EIA930_BALANCE_*.csv", readers.DEMAND_SCHEMA)
    rows = df.collect()
    assert len(rows) == 3 and {r.files_in_scan for r in rows} == {3}
    assert all("EIA930_BALANCE_" in r.source_file for r in rows)


def test_interpolation_is_time_linear_and_respects_the_gap_limit(spark):
    ts = hours(12)
    vals = [0.0, None, None, 30.0, None, None, None, None, 80.0, 90.0, None, None]
    df = spark.createDataFrame([("a", t, v) for t, v in zip(ts, vals)],
                               "city string, timestamp timestamp_ntz, temperature double")
    out = [r.temperature for r in series.interpolate_linear(df, ["temperature"], limit=3).orderBy("timestamp").collect()]
    assert out[:4] == [0.0, 10.0, 20.0, 30.0]          # 2-row gap: filled on the line
    assert out[4:8] == [None] * 4                      # 4-row gap > limit: left NULL
    assert out[8:10] == [80.0, 90.0] and out[10:] == [None, None]   # no later value: not extrapolated


def test_value_counts_ties_and_validation_zero_base(spark):
    from loadstats.operators import rollup, sample
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "k string")
    top = rollup.value_counts_top(df, ["k"], 2).orderBy("rank").collect()
    assert [(r.value, r["count"], r.n_unique) for r in top] == [("a", 2, 3), ("b", 2, 3)]   # tie -> by value
    full = spark.createDataFrame([(0.0,), (0.0,), (2.0,)], "x double")
    samp = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    v = sample.sample_validation(full, samp, ["x"]).first()
    assert v.median == 0.0 and v.median_diff_pct == 0.0                # zero base -> 0, not a division
    assert abs(v.mean_diff_pct - 50.0) < 1e-9
