"""The wide feature table against pandas, stored statistics, and the defined edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadstats.operators import wide


def hourly(n=400, seed=5):
    """Two cities of different length; weather with gaps at both ends; one outlier."""
    rng = np.random.default_rng(seed)
    frames = []
    for city, k in (("New York", n), ("new-york", n // 2)):
        t = pd.date_range("2024-03-01", periods=k, freq="h")
        one = pd.DataFrame({"city": city, "timestamp": t, "demand": 100 + 10 * rng.standard_normal(k)})
        for c in ("temperature", "humidity"):
            one[c] = np.where(rng.random(k) < 0.2, np.nan, np.round(rng.standard_normal(k) * 20))
        one["is_holiday"] = (t.day == 5).astype(int)
        frames.append(one)
    pdf = pd.concat(frames, ignore_index=True)
    pdf.loc[200, "demand"] = 400.0
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).repartition(7)


def collected(df):
    return df.orderBy("city", "timestamp").toPandas()


def by_pandas(pdf, leaky):
    medians = {c: pdf[c].median() for c in ("temperature", "humidity")}
    out = []
    for _, g in pdf.sort_values(["city", "timestamp"]).groupby("city", sort=True):
        g = g.copy()
        for c, m in medians.items():
            g[c] = g[c].ffill().bfill().fillna(m)
        x, back = g.demand, 0 if leaky else 1
        tail = "" if leaky else "_prev"
        for n, label in ((24, "1d"), (168, "1w")):
            g[f"demand_diff_{label}{tail}"] = (x - x.shift(n)).shift(back)
            g[f"demand_pct_change_{label}{tail}"] = (x / x.shift(n) - 1).shift(back).fillna(0)
        for n, label in ((24, "24h"), (168, "7d")):
            g[f"demand_ewm_{label}"] = x.shift(1).ewm(span=n).mean()
            g[f"demand_rolling_mean_{label}"] = x.shift(1).rolling(n).mean()
            g[f"demand_rolling_std_{label}"] = x.shift(1).rolling(n).std()
        g["demand_rolling_min_24h"] = x.shift(1).rolling(24).min()
        g["demand_rolling_max_24h"] = x.shift(1).rolling(24).max()
        for n in (24, 48, 168):
            g[f"demand_lag_{n}h"] = x.shift(n)
        odd = ((pdf.demand.mean() - x).abs() / pdf.demand.std() > 3).astype(int)
        g[f"is_anomaly{tail}"] = odd.shift(back).fillna(0)
        g["is_day_before_holiday"] = g.is_holiday.shift(-24).fillna(0)
        g["is_day_after_holiday"] = g.is_holiday.shift(24).fillna(0)
        for p in (24, 168, 8760):
            for k in (1, 2, 3):
                g[f"fourier_sin_{p}_{k}"] = np.sin(2 * np.pi * k * np.arange(len(g)) / p)
                g[f"fourier_cos_{p}_{k}"] = np.cos(2 * np.pi * k * np.arange(len(g)) / p)
        g["hour_sin"] = np.sin(2 * np.pi * g.timestamp.dt.hour / 24)
        g["is_weekend"] = (g.timestamp.dt.dayofweek >= 5).astype(int)
        out.append(g)
    g = pd.concat(out, ignore_index=True)
    for c in medians:
        s = (g[c] - g[c].min()) / (g[c].max() - g[c].min())
        g[f"{c}_scaled"], g[f"{c}_squared"], g[f"{c}_cubed"] = s, s ** 2, s ** 3
        g[f"{c}_binned"] = pd.qcut(g[c], 5, labels=False, duplicates="drop")
    g["temperature_humidity_interaction"] = g.temperature_scaled * g.humidity_scaled
    return g


@pytest.mark.parametrize("leaky", [False, True])
def test_equals_pandas(spark, leaky):
    pdf = hourly()
    table, names = wide.wide_features(frame(spark, pdf), leaky=leaky)
    got, want = collected(table), by_pandas(pdf, leaky)
    tested = [n for n in names if n in want]
    assert len(tested) >= 46 and len(names) == len(set(names))
    for n in tested:
        np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-9, atol=1e-9, err_msg=n)
    assert got["is_anomaly" if leaky else "is_anomaly_prev"].sum() >= 1


def test_no_feature_tells_the_rows_own_target(spark):
    """Another target in the last row of a city leaves that row's features alone, where the
    statistics are those of earlier rows (T4)."""
    pdf = hourly(260)
    df = frame(spark, pdf)
    fitted = wide.fit_wide(df)
    last = pdf.index[(pdf.city == "New York")][-1]
    other = pdf.copy()
    other.loc[last, "demand"] = 9999.0
    rows = []
    for p in (pdf, other):
        table, names = wide.wide_features(frame(spark, p), fitted)
        rows.append(table.where((F.col("city") == "New York") & (F.col("timestamp") == F.lit(pdf.timestamp[last]))).select(*names).first())
    assert rows[0] == rows[1] and rows[0] is not None


def test_stored_statistics_serve_the_same_columns(spark):
    """A statistic is one number, so a bundle's scaler table holds them; other rows get the
    same columns, values beyond the edges the outer bins and unknown cities 0."""
    pdf = hourly(200)
    df = frame(spark, pdf)
    fitted = wide.fit_wide(df)
    assert all(isinstance(k, str) and (v is None or isinstance(v, (int, float))) for k, v in fitted.items())
    stored = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in fitted.items()], "name string, value double")
    fitted = {r["name"]: r["value"] for r in stored.collect()}
    _, names = wide.wide_features(df, fitted)
    new = pd.DataFrame({"city": ["Oslo", None, "New York"], "timestamp": pd.date_range("2024-05-01", periods=3, freq="h"),
                        "demand": [1.0, 2.0, 3.0], "temperature": [-1e6, 1e6, np.nan], "humidity": [0.0, 0.0, 0.0]})
    table, again = wide.wide_features(frame(spark, new), fitted)
    assert again == names
    got = {r.city: r for r in table.collect()}
    edges = [k for k in fitted if k.startswith("temperature_edge_")]
    assert got["Oslo"].temperature_binned == 0 and got[None].temperature_binned == len(edges) - 2
    assert got["New York"].temperature == fitted["temperature_median"]
    cities = sorted(wide.city_columns(fitted).values())
    assert cities == ["city_new_york", "city_new_york_1"]
    assert [sum(got[c][n] for n in cities) for c in ("Oslo", None, "New York")] == [0, 0, 1]


def test_small_chunks_and_a_long_series(spark, monkeypatch):
    """Chunks of 200 positions give what whole series give."""
    from loadstats.operators import frames
    pdf = hourly(1200)
    fitted = wide.fit_wide(frame(spark, pdf))
    whole = collected(wide.wide_features(frame(spark, pdf), fitted)[0])
    for f in (frames.framed, frames.sliding):
        monkeypatch.setitem(f.__kwdefaults__, "chunk_rows", 200)
    monkeypatch.setattr(frames.carry_both, "__defaults__", tuple(200 if d == frames.DEFAULT_CHUNK_ROWS else d
                                                                 for d in frames.carry_both.__defaults__))
    cut = collected(wide.wide_features(frame(spark, pdf), fitted)[0])
    assert list(cut.columns) == list(whole.columns)
    for n in whole.columns[2:]:
        np.testing.assert_allclose(cut[n].astype(float), whole[n].astype(float), rtol=1e-9, atol=1e-9, err_msg=n)


def test_defined_cases(spark):
    schema = "city string, timestamp timestamp_ntz, demand double, temperature double"
    empty = spark.createDataFrame([], schema)
    table, names = wide.wide_features(empty)
    assert table.count() == 0 and "temperature_binned" in names and set(names) <= set(table.columns)
    bare = frame(spark, hourly(60)[["city", "timestamp", "demand"]])
    table, names = wide.wide_features(bare)
    assert not [n for n in names if n.startswith(("temperature", "humidity"))]
    assert table.agg(F.sum("is_holiday"), F.sum("is_day_before_holiday")).first()[0] == 0
    flat = bare.select("*", F.lit(3.0).alias("temperature"), F.lit(None).cast("double").alias("humidity"))
    row = wide.wide_features(flat)[0].agg(F.max("temperature_scaled").alias("s"), F.max("temperature_binned").alias("b"),
                                         F.count("humidity_scaled").alias("h"), F.count("humidity_binned").alias("hb")).first()
    assert tuple(row) == (0.0, 0, 0, 0)
    clash = bare.withColumn("hour_sin", F.lit("text")).withColumn("anomaly_z", F.lit(True)).withColumn("extra", F.lit(1))
    table, _ = wide.wide_features(clash, leaky=True)
    assert dict(table.dtypes)["hour_sin"] == "double" and table.columns.count("hour_sin") == 1
    assert table.where("is_anomaly = 1 AND extra = 1").count() == table.count() > 0
    with pytest.raises(ValueError):
        wide.wide_features(bare, most_cities=1)
    assert [n for n in wide.wide_features(bare, cities=["New York"], most_cities=1)[1] if n.startswith("city_")] == ["city_new_york"]


def test_vectors_are_the_complete_rows(spark):
    from pyspark.ml.functions import vector_to_array
    table, names = wide.wide_features(frame(spark, hourly(300)))
    rows = wide.complete_vectors(table, names)
    assert rows.count() == 300 - 169                        # the shorter city has too little history
    row = rows.withColumn("v", vector_to_array("features")).first()
    assert row.v == [float(row[n]) for n in names]
