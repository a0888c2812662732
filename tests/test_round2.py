"""Cases that earlier fixtures did not hold: fine values, NULL keys, long gaps, resumed streams."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
SCHEMA = "city string, timestamp timestamp_ntz, demand double"


def series_frame(spark, n=400, null_key=True, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(c, T0 + timedelta(hours=i), float(rng.normal(10, 2)) if rng.random() > 0.2 else None)
            for c in (("a", None) if null_key else ("a",)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_daily_mean_keeps_fine_values(spark):
    from loadstats.operators.rollup import daily_summary
    df = spark.createDataFrame([("c", T0, 0.004, 1.0), ("c", T0, 0.003, 2.0)], SCHEMA + ", temperature double")
    row = daily_summary(df).first()
    assert row["avg_demand"] == pytest.approx(0.0035) and row["avg_temp"] == 1.5


def test_correlation_over_complete_pairs(spark):
    from loadstats.operators.rollup import corr_with_target, safe_corr
    x = [1.0, 2.0, 3.0, None, 5.0, 7.0]
    y = [2.0, None, 1.0, 9.0, 6.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    want = pd.DataFrame({"x": x, "y": y}).corr().iloc[0, 1]
    assert df.agg(safe_corr("x", "y")).first()[0] == pytest.approx(want)
    assert corr_with_target(df, ["x"], "y").first()["abs_corr"] == pytest.approx(abs(want))


@pytest.mark.parametrize("chunk_rows", [None, 560])
def test_ewm_equals_pandas_over_a_long_gap(spark, chunk_rows):
    from loadstats.operators.series import ewm_mean
    v = np.random.default_rng(1).normal(10, 2, 9000)
    v[100:8990] = np.nan
    df = spark.createDataFrame([("a", T0 + timedelta(hours=i), None if np.isnan(x) else float(x)) for i, x in enumerate(v)], SCHEMA)
    got = ewm_mean(df, 24, chunk_rows=chunk_rows).orderBy("timestamp").toPandas()["demand_ewm_24"].to_numpy(dtype=float)
    want = pd.Series(v).ewm(span=24, adjust=True).mean().shift(1).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rows_with_a_null_key_stay(spark):
    from loadstats.operators import frames, sample
    df, rows = series_frame(spark)
    assert frames.with_position(df).count() == len(rows)
    assert sample.split_chronological(df).groupBy("city").count().count() == 2
    assert sample.split_three_way(df).count() == len(rows)
    lagged = frames.framed(df, lambda w: [F.lag("demand", 3).over(w).alias("x")], back=3, chunk_rows=50)
    got = {(r["city"], r["timestamp"]): r["x"] for r in lagged.collect()}
    values = {(c, t): v for c, t, v in rows}
    assert len(got) == len(rows)
    assert all(x == values.get((c, t - timedelta(hours=3))) for (c, t), x in got.items())
    filled = frames.carry_forward(df, ["demand"], chunk_rows=40).collect()
    assert len(filled) == len(rows) and sum(r["demand"] is None for r in filled) <= 4


def test_statistics_keep_their_types(spark):
    from loadstats.functions.stats import attach_scalars
    df = spark.createDataFrame([(T0, None, 1)], "t timestamp_ntz, s string, n int")
    out = attach_scalars(df, [F.count(F.lit(1)).alias("c"), F.min("t").alias("lo"), F.max("s").alias("hi"),
                              F.collect_list("n").alias("l")])
    assert dict(out.dtypes) | {} == {"t": "timestamp_ntz", "s": "string", "n": "int", "c": "bigint",
                                     "lo": "timestamp_ntz", "hi": "string", "l": "array<int>"}
    assert out.first()["lo"] == T0


def test_strata_keys_do_not_collide(spark):
    from loadstats.functions.calendar import concat_key
    rows = [("a_b", "c"), ("a", "b_c"), ("a", None), (None, "a"), ("a", "\\N"), ("a\\", "b"), ("a", "\\b"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    keys = [r[0] for r in df.select(concat_key(["x", "y"])).collect()]
    assert len(set(keys)) == len(rows)


def test_hourly_stream_goes_on_where_it_stopped(spark, tmp_path):
    from loadstats.streaming.hourly import run_hourly_demand
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    row = lambda i, v: (i, T0 + timedelta(minutes=30 * i), "view", v)
    make = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1)
    make([row(0, 1.0), row(1, 2.0), row(2, 4.0)]).write.mode("append").parquet(src)
    first = run_hourly_demand(spark, src, sink, ck).collect()
    make([row(3, 8.0), row(4, 16.0)]).write.mode("append").parquet(src)
    second = {r["timestamp"].hour: r["demand"] for r in run_hourly_demand(spark, src, sink, ck).collect()}
    assert {r["timestamp"].hour: r["demand"] for r in first} == {0: 3.0, 1: 4.0}
    assert second == {0: 3.0, 1: 12.0, 2: 16.0}


def test_permutation_deals_every_value_once(spark):
    from loadstats.plans.catalog_models import _permuted
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.lit(1).alias("w"))
    got = _permuted(df, "v", ["k"]).collect()
    assert sorted(r["v"] for r in got) == [3 * i for i in range(500)] and sum(r["v"] == 3 * r["k"] for r in got) < 20
