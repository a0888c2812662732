"""Anomaly flags (N1-N5) and the isolation forest.

Thresholds are fitted by one aggregate and broadcast as a one-row table
(J6), globally by default (reference parity, T22) or per group with ``by``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import attach_scalars
from .frames import computed_once
from .quantiles import attach_quantiles

# Fixed values: |z| above 3, IQR fence factor 1.5, forest of 100 trees on 256-row samples,
# 1 % contamination, seed 42.
Z_THRESHOLD = 3.0
IQR_FACTOR = 1.5
IFOREST_TREES = 100
IFOREST_SAMPLE = 256
IFOREST_CONTAMINATION = 0.01
IFOREST_SEED = 42


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def _attach(df: DataFrame, aggs, by=None) -> DataFrame:
    if by:
        keys = _as_list(by)
        return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")
    return attach_scalars(df, aggs)


def anomaly_zscore(df: DataFrame, cols: Sequence[str], threshold: float = Z_THRESHOLD, by=None,
                   out: str = "anomaly_z") -> DataFrame:
    """Any column with |x - mean| / sample std > threshold."""
    aggs = [F.avg(c).alias(f"_mu_{c}") for c in cols] + [F.stddev_samp(c).alias(f"_sd_{c}") for c in cols]
    j = _attach(df, aggs, by)
    conds = [F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}"))) > threshold,
                        F.lit(False)) for c in cols]
    flag = conds[0]
    for c in conds[1:]:
        flag = flag | c
    return j.select(*df.columns, flag.alias(out))


def anomaly_iqr(df: DataFrame, cols: Sequence[str], factor: float = IQR_FACTOR, by=None,
                accuracy: int | None = None, out: str = "anomaly_iqr") -> DataFrame:
    """Any column outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] (linear quantiles)."""
    j = attach_quantiles(df, cols, [0.25, 0.75], by, accuracy=accuracy)
    conds = []
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        iqr = q3 - q1
        conds.append(F.coalesce((F.col(c) < q1 - factor * iqr) | (F.col(c) > q3 + factor * iqr), F.lit(False)))
    flag = conds[0]
    for c in conds[1:]:
        flag = flag | c
    return j.select(*df.columns, flag.alias(out))


def anomaly_z_and_iqr(df: DataFrame, cols: Sequence[str], by=None, accuracy: int | None = None,
                      threshold: float = Z_THRESHOLD, factor: float = IQR_FACTOR) -> DataFrame:
    """N1 + N2 over an input that is computed once."""
    df = computed_once(df)
    aggs = [F.avg(c).alias(f"_mu_{c}") for c in cols] + [F.stddev_samp(c).alias(f"_sd_{c}") for c in cols]
    j = _attach(attach_quantiles(df, cols, [0.25, 0.75], by, accuracy=accuracy), aggs, by)
    z = [F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}"))) > threshold, F.lit(False))
         for c in cols]
    q = []
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        q.append(F.coalesce((F.col(c) < q1 - factor * (q3 - q1)) | (F.col(c) > q3 + factor * (q3 - q1)), F.lit(False)))
    zf, qf = z[0], q[0]
    for a, b in zip(z[1:], q[1:]):
        zf, qf = zf | a, qf | b
    return j.select(*df.columns, zf.alias("anomaly_z"), qf.alias("anomaly_iqr"))


def anomaly_any(df: DataFrame, value: str = "demand", flags=("anomaly_z", "anomaly_iqr", "anomaly_iso"),
                out: str = "is_anomaly") -> DataFrame:
    """OR of the flag columns present; otherwise |z(value)| > 3."""
    present = [f for f in flags if f in df.columns]
    if present:
        flag = F.lit(False)
        for f in present:
            flag = flag | F.coalesce(F.col(f), F.lit(False))
        return df.withColumn(out, flag.cast("int"))
    z = anomaly_zscore(df, [value], out="_z")
    return z.withColumn(out, F.col("_z").cast("int")).drop("_z")


def clean_dataset(df: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """Drop IQR anomalies."""
    flagged = anomaly_iqr(df, cols, **kw)
    return flagged.where(~F.col("anomaly_iqr")).drop("anomaly_iqr")


# ---------------------------------------------------------------- isolation forest

def _c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


TREE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType())])


def _grow_tree(pdf: pd.DataFrame, cols: list[str], max_depth: int, seed: int) -> pd.DataFrame:
    """Build one isolation tree on its sample (runs inside an executor task)."""
    tree_id = int(pdf["_tree"].iloc[0])
    rng = np.random.default_rng([seed, tree_id])
    x = pdf[cols].to_numpy(dtype=float)
    nodes = []

    def grow(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx))
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[me] = (tree_id, me, -1, 0.0, -1, -1, len(idx))
            return me
        f = int(rng.choice(usable))
        s = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < s]
        right = idx[sub[:, f] >= s]
        li = grow(left, depth + 1)
        ri = grow(right, depth + 1)
        nodes[me] = (tree_id, me, f, s, li, ri, len(idx))
        return me

    grow(np.arange(len(x)), 0)
    return pd.DataFrame(nodes, columns=[f.name for f in TREE_SCHEMA.fields])


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str], n_trees: int = IFOREST_TREES,
                         sample_size: int = IFOREST_SAMPLE, seed: int = IFOREST_SEED) -> DataFrame:
    """Tree table (tree, node, feature, split, left, right, size).

    Each row's key is hashed once and that hash is mixed with every tree's number; a tree
    keeps the ``sample_size`` rows with the smallest results (a seeded sample without
    replacement). The test against ~4x the needed rate runs in generated code before the
    shuffle, so only a few thousand candidates per tree are sent, whatever the table size.
    """
    from ..session import ship_package
    ship_package(df.sparkSession)
    cols = list(cols)
    data = df.select(*key, *cols).na.drop(subset=cols)
    n = data.count()
    size = min(sample_size, n)
    rate = min(1.0, 4.0 * size / max(n, 1) + 1e-9)
    kcols = [F.col(k).cast("string") for k in key]
    trees = F.explode(F.array(*[F.lit(t) for t in range(n_trees)])).alias("_tree")
    u = F.xxhash64("_h", "_tree")
    cand = (data.select(*cols, F.xxhash64(*kcols, F.lit(seed)).alias("_h")).select("*", trees)
                .select(*cols, "_tree", u.alias("_u")).where(F.col("_u") < F.lit(int((rate - 0.5) * 2 ** 64) if rate < 1.0 else 2 ** 63 - 1)))
    w = Window.partitionBy("_tree").orderBy("_u")
    sample = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r", "_u")
    max_depth = int(math.ceil(math.log2(max(size, 2))))
    return sample.groupBy("_tree").applyInPandas(
        lambda pdf: _grow_tree(pdf, cols, max_depth, seed), TREE_SCHEMA)


def _path_lengths(x: np.ndarray, trees: dict) -> np.ndarray:
    total = np.zeros(len(x))
    for nodes in trees.values():
        feat, split, left, right, size, leaf_c = nodes
        cur = np.zeros(len(x), dtype=np.int64)
        depth = np.zeros(len(x))
        active = feat[cur] >= 0
        while active.any():
            f = feat[cur[active]]
            go_left = x[active, f] < split[cur[active]]
            cur[active] = np.where(go_left, left[cur[active]], right[cur[active]])
            depth[active] += 1
            active = feat[cur] >= 0
        total += depth + leaf_c[cur]
    return total / max(len(trees), 1)


def score_isolation_forest(df: DataFrame, trees: DataFrame, cols: Sequence[str],
                           sample_size: int = IFOREST_SAMPLE, out: str = "iso_score") -> DataFrame:
    """Anomaly score 2^(-E[h]/c(psi)) per row, vectorised per Arrow batch.

    The tree table has at most n_trees * (2 * sample_size - 1) rows, a fixed
    bound, so it is collected once and shipped to the tasks as a broadcast.
    """
    cols = list(cols)
    pdf = trees.toPandas()
    sc = df.sparkSession.sparkContext
    by_tree = {}
    for t, g in pdf.groupby("tree"):
        g = g.sort_values("node")
        size = g["size"].to_numpy()
        by_tree[int(t)] = (g["feature"].to_numpy(), g["split"].to_numpy(), g["left"].to_numpy(),
                           g["right"].to_numpy(), size,
                           np.array([_c_factor(s) for s in size]))   # per-node leaf correction, once per tree
    bc = sc.broadcast(by_tree)
    psi = min(sample_size, int(pdf.loc[pdf["node"] == 0, "size"].max() or 2))
    cn = _c_factor(psi)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = bc.value
        for b in batches:
            x = np.stack([c.to_numpy(dtype=float) for c in b], axis=1)
            ok = ~np.isnan(x).any(axis=1)
            s = np.full(len(x), np.nan)
            if ok.any():
                s[ok] = np.power(2.0, -_path_lengths(x[ok], forest) / cn)
            yield pd.Series(s)
    # only the scored columns travel to Python
    return df.withColumn(out, F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in cols]))


def anomaly_isolation_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ("city", "timestamp"),
                             contamination: float = IFOREST_CONTAMINATION, seed: int = IFOREST_SEED,
                             n_trees: int = IFOREST_TREES, sample_size: int = IFOREST_SAMPLE,
                             accuracy: int = 10000, out: str = "anomaly_iso") -> DataFrame:
    """Flag the ``contamination`` share of rows with the highest scores."""
    from ..session import materialize
    df = computed_once(df)                      # counted, sampled and scored
    # numbers of a fixed size a row: a few tasks' worth at least, however small the input's files are
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    trees = fit_isolation_forest(df, cols, list(key), n_trees, sample_size, seed)
    # scoring (every row through every tree) is the heavy part: do it once, then
    # derive both the 1 % cut and the flags from the written scores
    scored = materialize(score_isolation_forest(df, trees, cols, sample_size))
    return (attach_scalars(scored, [F.percentile_approx("iso_score", 1.0 - contamination, accuracy).alias("_cut")])
                  .withColumn(out, F.coalesce(F.col("iso_score") > F.col("_cut"), F.lit(False)))
                  .drop("_cut"))
