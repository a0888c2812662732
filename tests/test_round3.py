"""Rank selection, sliding statistics, chunked running means, tails and the Gram table."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def skewed(n=60_000, seed=3):
    """One city with nine tenths of the rows; ties, NULLs, NaN, infinities and a NULL city."""
    rng = np.random.default_rng(seed)
    city = np.where(rng.random(n) < 0.9, "big", np.where(rng.random(n) < 0.5, "small", "tiny")).astype(object)
    city[rng.random(n) < 0.001] = None
    x = np.exp(rng.standard_normal(n) * 8)
    y = np.round(rng.standard_normal(n) * 3) / 2
    return pd.DataFrame({"city": city, "x": x, "y": y, "z": np.full(n, np.nan)}), rng


@pytest.fixture(scope="module")
def skewed_frame(spark):
    pdf, rng = skewed()
    gone = F.col("id") % 17 == 0
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~gone, F.col("x"))).withColumn("z", F.lit(None).cast("double"))
    return df.repartition(16), pdf


@pytest.mark.parametrize("small", [200_000, 3_000, 60])
def test_quantiles_equal_percentile(spark, skewed_frame, small):
    from loadstats.operators.quantiles import quantiles
    df, _ = skewed_frame
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    p = F.array(*[F.lit(v) for v in probs])
    want = {r.city: r for r in df.groupBy("city").agg(*[F.percentile(c, p).alias(c) for c in "xyz"]).collect()}
    got = {r.city: r for r in quantiles(df, ["x", "y", "z"], probs, "city", small=small).collect()}
    assert set(got) == set(want) == {"big", "small", "tiny", None}
    for city, r in want.items():
        for c in "xy":
            assert got[city][c] == pytest.approx(r[c], rel=1e-14, abs=0), (city, c)
        assert got[city].z is None
    whole = df.agg(*[F.percentile(c, p).alias(c) for c in "xy"]).first()
    one = quantiles(df, ["x", "y"], probs, small=small).first()
    assert [one.x, one.y] == [pytest.approx(whole.x, rel=1e-14), pytest.approx(whole.y, rel=1e-14)]


def test_quantile_ranges_that_miss_grow(spark, skewed_frame, monkeypatch):
    """Ranges far from their ranks: the counts tell, and the answer stays exact."""
    from loadstats.operators import quantiles as q
    df, _ = skewed_frame
    seen, real = [], q._ranges

    def wrong(long, group, probs, small, accuracy, spread):
        seen.append(spread)
        r = real(long, group, probs, small, accuracy, spread)
        return r.withColumn("_b", F.transform("_b", lambda b: b + 1e-3)) if len(seen) == 1 else r
    monkeypatch.setattr(q, "_ranges", wrong)
    got = q.quantiles(df.where("city = 'big'"), ["y"], [0.5], "city", small=500).first()
    want = df.where("city = 'big'").agg(F.percentile("y", 0.5)).first()[0]
    assert got.y == [want] and len(seen) > 1 and seen == sorted(set(seen))


def test_hot_group_is_counted_by_many_tasks(spark, skewed_frame):
    """What is shuffled for a hot group are counts of values near the ranks, by value."""
    from loadstats.operators import quantiles as q
    df, _ = skewed_frame
    long = q._long(df.where("city = 'big'"), ["city"], ["x"])
    table = q._ranges(long, ["city", "_c"], [0.5], 1_000, q.FINEST, 2.0)
    plan = q._picked(long, ["city", "_c"], [0.5], table)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "collect" not in plan
    kept = long.join(table.drop("_n"), ["city", "_c"]).where("_v >= _b[0] and _v <= _b[1]").count()
    assert kept < 2_000 < long.count() / 20


def test_quantiles_of_nothing_and_of_odd_values(spark):
    from loadstats.operators.quantiles import attach_quantiles, quantile_lists
    empty = spark.createDataFrame([], "city string, v double")
    assert quantile_lists(empty, ["v"], [0.5]) == {"v": None}
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", float("-inf")), ("a", None),
                                 ("b", None), (None, -0.0), (None, 2.0)], "city string, v double")
    got = {r.city: r["_q_v"] for r in attach_quantiles(odd, ["v"], [0.0, 1 / 3, 1.0], "city").collect()}
    assert got["a"][:2] == [float("-inf"), 1.0] and math.isnan(got["a"][2])
    assert got["b"] is None and got[None] == pytest.approx([0.0, 2 / 3, 2.0])


# -- series ------------------------------------------------------------------------------

def series_frame(spark, sizes, seed=5, holes=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for city, n in sizes.items():
        t = pd.date_range("2024-01-01", periods=n, freq="h")
        v = np.round(rng.gamma(2, 300, n) + 1e6 * (city == "b"), 2)
        rows.append(pd.DataFrame({"city": city, "timestamp": t, "demand": v, "gone": rng.random(n) < holes}))
    pdf = pd.concat(rows, ignore_index=True)
    pdf.loc[pdf.gone, "demand"] = np.nan
    df = spark.createDataFrame(pdf[["city", "timestamp", "demand"]]).withColumn(
        "demand", F.when(~F.isnan("demand"), F.col("demand"))).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df, pdf


@pytest.mark.parametrize("chunk_rows", [1 << 16, 40])
@pytest.mark.parametrize("shift", [1, 0])
def test_sliding_equals_pandas(spark, chunk_rows, shift):
    from loadstats.operators.frames import sliding
    df, pdf = series_frame(spark, {"a": 400, "b": 171, "c": 5, "d": 1}, holes=0.01)
    names = {(n, s): f"{s}_{n}" for n in (1, 2, 7, 24) for s in ("mean", "std", "min", "max")}
    got = sliding(df, "demand", names, shift=shift, chunk_rows=chunk_rows).toPandas().sort_values(["city", "timestamp"])
    for city, g in pdf.groupby("city"):
        mine = got[got.city == city].reset_index(drop=True)
        for (n, s), name in names.items():
            want = getattr(g.demand.shift(shift).rolling(n), s)().reset_index(drop=True)
            exact = [np.nan if i + 1 < n else np.std(w, ddof=1) if s == "std" and n > 1 else None
                     for i, w in enumerate(g.demand.shift(shift).rolling(n))]
            if s == "std" and n > 1:                    # pandas' own running variance cancels digits
                want = pd.Series(exact, dtype=float).where(want.notna())
            np.testing.assert_allclose(mine[name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=f"{city} {name}")


def test_sliding_frames_take_one_step_a_row(spark):
    from loadstats.operators.series import rolling_stats
    df, _ = series_frame(spark, {"a": 30})
    plan = rolling_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    frames = [f.split("specifiedwindowframe(RowFrame, ")[1].split(")")[0] for f in plan.split("windowspecdefinition")
              if "specifiedwindowframe(RowFrame, " in f]
    assert frames and all(f.startswith("unboundedpreceding") or f.split(", ")[0] == f.split(", ")[1] for f in frames)


@pytest.mark.parametrize("chunk_rows", [1 << 16, 7])
def test_historical_average_in_chunks(spark, chunk_rows):
    from loadstats.operators.series import historical_average
    df, pdf = series_frame(spark, {"a": 24 * 7 * 30, "b": 24 * 7 * 3}, holes=0.2)
    got = historical_average(df, chunk_rows=chunk_rows).toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)
    pdf = pdf.sort_values(["city", "timestamp"]).reset_index(drop=True)
    key = [pdf.city, pdf.timestamp.dt.hour, pdf.timestamp.dt.weekday]
    want = pdf.groupby(key).demand.transform(lambda x: x.expanding().mean().shift())
    np.testing.assert_allclose(got.predicted.astype(float), want, rtol=1e-12)


@pytest.mark.parametrize("n", [1, 100, 168, 900, 5000])
def test_tail_window_ranks_one_bucket(spark, n):
    from loadstats.operators.series import tail_window
    df, pdf = series_frame(spark, {"a": 1000, "b": 169, "c": 3})
    got = tail_window(df, n).toPandas().groupby("city").timestamp.agg(["count", "min", "max"])
    want = pdf.groupby("city").tail(n).groupby("city").timestamp.agg(["count", "min", "max"])
    assert got.astype(str).equals(want.astype(str))
    nothing = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0)], df.schema)
    assert tail_window(df.unionByName(nothing), 5000).where("timestamp IS NULL").count() == 2


# -- correlations --------------------------------------------------------------------------

def test_gram_table_of_300_columns(spark):
    from loadstats.operators.rollup import corr_of_many, corr_pairs
    rng = np.random.default_rng(1)
    n, k = 1_200, 300
    x = rng.standard_normal((n, 8)) @ rng.standard_normal((8, k)) + rng.standard_normal((n, k)) + 1e6 * rng.integers(0, 3, k)
    x[:, 7] = 5.25
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    pdf = pdf.mask(rng.random((n, k)) < 0.05)
    pdf["c9"] = np.nan
    import pyarrow as pa
    df = spark.createDataFrame(pa.Table.from_pandas(pdf, preserve_index=False)).repartition(6)
    got = {(r.a, r.b): r.r for r in corr_of_many(df, list(pdf.columns)).collect()}
    assert len(got) == k * (k - 1) // 2
    want = pdf.corr()
    for i in rng.integers(0, k, 400):
        for j in rng.integers(0, k, 3):
            a, b = f"c{min(i, j)}", f"c{max(i, j)}"
            if i != j:
                w = want.loc[a, b]
                if {7, 9} & {int(i), int(j)}:
                    assert got[a, b] is None
                else:
                    assert got[a, b] == pytest.approx(w, abs=1e-9)
    cols = list(pdf.columns[:7])
    few = sorted((r.a, r.b, round(r.r, 9)) for r in corr_pairs(df, cols).collect())
    many = sorted((r.a, r.b, round(r.r, 9)) for r in corr_pairs(df, cols, few=0).collect())
    assert few == many


# -- positions ------------------------------------------------------------------------------

def test_positions_of_a_dense_week(spark):
    """A million rows in one week of one city, a third of them in one second: no task numbers
    more than the set number of rows."""
    from loadstats.operators import frames
    n, most = 1_000_000, 60_000
    at = F.when(F.col("id") % 3 == 0, F.lit(1000)).otherwise(F.col("id") % 400_000)
    df = spark.range(n).select(F.lit("a").alias("city"), F.timestamp_seconds(F.lit(1_704_067_200) + at).alias("timestamp"),
                               F.col("id").alias("demand"))
    few = spark.range(50).select(F.lit("b").alias("city"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("timestamp"),
                                 (F.col("id") + n).alias("demand"))
    none = spark.range(5).select(F.lit("b").alias("city"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(-1).cast("long").alias("demand"))
    df = df.unionByName(few).unionByName(none)
    cut, cell = frames._fine_buckets(df, ["city"], "timestamp", frames.DEFAULT_BUCKET_SECONDS, most, True)
    assert cut.groupBy("city", *cell).count().agg(F.max("count")).first()[0] <= most
    p = frames.with_position(df, most_rows=most)
    per = p.groupBy("city").agg(F.count("*").alias("n"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi"),
                                F.count_distinct("_pos").alias("d"))
    assert {r.city: (r.n, r.lo, r.hi, r.d) for r in per.collect()} == {"a": (n, 0, n - 1, n), "b": (55, 0, 54, 55)}
    back = p.where("city = 'a'").groupBy("timestamp").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.count("*").alias("n"))
    wrong = back.join(df.where("city = 'a'").groupBy("timestamp").count(), "timestamp").where("hi - lo + 1 != n")
    assert wrong.count() == 0                                # equal times stand together
    first = [r.timestamp for r in p.where("city = 'b'").orderBy("_pos").collect()]
    assert first[:5] == [None] * 5 and first[5:] == sorted(first[5:])


def test_positions_with_a_tiebreak_keep_its_order(spark):
    from loadstats.operators.frames import with_position
    df = spark.range(3000).select(F.lit("a").alias("city"), F.timestamp_seconds(F.col("id") % 7).alias("timestamp"),
                                  (F.col("id") * 37 % 3001).alias("k"))
    got = [(r.timestamp, r.k) for r in with_position(df, tiebreak=["k"], most_rows=100).orderBy("_pos").collect()]
    assert got == sorted(got)


# -- bundles, weights, keys, sketches ----------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = spark.createDataFrame([(float(i), float(i % 5), 3.0 * i + i % 5) for i in range(60)], "a double, b double, demand double")
    return df, Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                                LinearRegression(featuresCol="features", labelCol="demand")]).fit(df)


@pytest.mark.parametrize("part", ["model/metadata", "scaler/_SUCCESS", "weights/_SUCCESS", "manifest/_SUCCESS", None])
def test_bundle_fails_if_a_part_is_absent(spark, fitted, tmp_path, part):
    import shutil
    from loadstats.sources.bundle import WEIGHTS_SCHEMA, load_bundle, save_bundle
    df, model = fitted
    weights = spark.createDataFrame([("ensemble", 0.7, 0.3, 0.9)], WEIGHTS_SCHEMA)
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, path)
    for _ in range(2):                                       # saved again, it switches over
        save_bundle(spark, path, model, ["a", "b"], {"a_min": 0.0, "a_max": 59.0, "b_min": None}, weights)
    if part is None:
        b = load_bundle(spark, path)
        assert b.features == ["a", "b"] and b.scaler == {"a_min": 0.0, "a_max": 59.0, "b_min": None}
        assert [tuple(r) for r in b.weights.collect()] == [("ensemble", 0.7, 0.3, 0.9)]
        got = [r.prediction for r in b.model.transform(df).collect()]
        assert got == [r.prediction for r in model.transform(df).collect()]
        return
    folder = spark.read.parquet(f"{path}/manifest").first()["folder"]
    gone = tmp_path / "bundle" / (part if part.startswith("manifest") else f"{folder}/{part}")
    shutil.rmtree(gone) if gone.is_dir() else gone.unlink()
    with pytest.raises(FileNotFoundError, match=part.split("/")[0]):
        load_bundle(spark, path)


def test_weights_table_and_model_choice(spark, tmp_path):
    from loadstats.sources.bundle import WEIGHTS_SCHEMA, chosen_model, served, weights_table, write_weights
    grid = spark.createDataFrame([(0.8, 0.2, 1.5, False), (0.5, 0.5, 1.0, True)], "w_a double, w_b double, mae double, is_best boolean")
    path = write_weights(spark.createDataFrame([("other", 0.1, 0.9, 1.0), ("ensemble", 1.0, 0.0, 1.0)], WEIGHTS_SCHEMA), str(tmp_path / "w"))
    write_weights(weights_table(grid, second_factor=0.9), path)
    table = spark.read.schema(WEIGHTS_SCHEMA).parquet(path)
    assert sorted(tuple(r) for r in table.collect()) == [("ensemble", 0.5, 0.5, 0.9), ("other", 0.1, 0.9, 1.0)]
    preds = spark.createDataFrame([("xgboost", 100.0), ("ensemble", 100.0), ("what", 100.0), (None, 100.0)], "asked string, predicted double")
    got = {r.asked: (r.model, r.predicted) for r in served(preds, table, F.col("asked")).collect()}
    both = ("ensemble", pytest.approx(95.0))
    assert got == {"xgboost": ("xgboost", 100.0), "ensemble": both, "what": both, None: both}
    assert served(preds.limit(1), table.limit(0), "lstm").first()["predicted"] == pytest.approx(97.0)
    assert [chosen_model(x) for x in ("xgboost", "ensemble", "lstm", None)] == ["xgboost", "ensemble", "ensemble", "ensemble"]


def test_join_checks_its_keys_on_its_own_shuffle(spark):
    from loadstats.operators.clean import duplicate_report, join_demand_weather
    left = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "city string, timestamp int, demand double")
    right = spark.createDataFrame([("a", i, -1.0) for i in range(7)], "city string, timestamp int, temperature double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = join_demand_weather(left, right, unique=True)
        assert good.count() == 7 and good.columns == ["city", "timestamp", "demand", "temperature"]
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
        for a, b in ((left.union(left.limit(1)), right), (left, right.union(right.limit(2)))):
            with pytest.raises(Exception, match="duplicate join key a 0"):
                join_demand_weather(a, b, unique=True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = duplicate_report(left.union(left.limit(1)), right.union(right.limit(2))).collect()
    assert sorted(tuple(r) for r in got) == [("left", "a", 0, 2), ("right", "a", 0, 2), ("right", "a", 1, 2)]


def test_distinct_sketches_merge_within_their_error(spark):
    from loadstats.operators.rollup import distinct_estimates, distinct_sketches
    df = spark.range(200_000).select((F.col("id") % 70_001).alias("many"), (F.col("id") % 13).alias("few"),
                                     F.lit(None).cast("string").alias("none"), (F.col("id") % 30).alias("day"))
    days = distinct_sketches(df, ["many", "few", "none"], F.col("day").cast("string"))
    assert days.count() == 90
    got = {r.column: (r.n, r.n_unique) for r in distinct_estimates(days).collect()}
    assert got["few"] == (200_000, 13) and got["none"] == (0, 0)
    assert got["many"][0] == 200_000 and abs(got["many"][1] - 70_001) < 4 * 0.0082 * 70_001
    whole = {r.column: r.n_unique for r in distinct_estimates(distinct_sketches(df, ["many", "few"])).collect()}
    assert abs(whole["many"] - got["many"][1]) < 0.03 * 70_001


def test_a_quantile_on_a_tie_is_the_value(spark):
    """Between two equal values the weights must not leave the value by a rounding error."""
    from loadstats.operators.quantiles import quantiles
    values = [0.1, 0.7 / 3, 1.1 / 7, 0.0533333333333333]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values) for _ in range(10)], "city string, x double")
    got = {r.city: r.x for r in quantiles(df, ["x"], [i / 7 for i in range(8)], "city").collect()}
    assert got == {str(i): [v] * 8 for i, v in enumerate(values)}
