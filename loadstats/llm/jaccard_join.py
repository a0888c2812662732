"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set holds the 64-bit hashes of its distinct word n-grams, sorted. Sets
similar enough share one of the smallest ``n - ceil(t n) + 1`` hashes of either (the
prefix), and their sizes are within the factor ``t``. So a tile is (prefix hash, size
band): the band's own sets and, as guests, those of the next band up; what is compared
holds one of its own that can be the smaller.

In a tile, bits of hashed bitmaps that only one of two sets has are elements that only it
has, which bounds the overlap from above; pairs that pass are intersected exactly. Pairs
already connected are skipped, so a large group of near copies costs one intersection a
member, not all pairs.

The work narrows step by step, and each pair that may be similar survives every step:

1. Equal sets become one.
2. Any order of the hashes that all sets keep gives right prefixes. The order here puts
   the hashes of common passages last, so that texts which share no more than a passage
   do not meet: common ones are counted in an eighth of the documents (which hashes those
   are changes the work, never the result). Tiles of each prefix's first two hashes:
   bitmaps alone connect candidates into clusters.
3. Tiles of the whole prefix, but only of hashes that two clusters share, again by bitmaps
   alone: whatever passes joins its clusters. Now every similar pair is inside a cluster.
4. Clusters are intersected, each set sent once (large clusters in blocks, see
   :func:`_intersected`). What is found links documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, components, mixed, releasing, runs, saved, sendable, spans_hashed, word_hasher

WORDS = 5
SHARE = (75, 100)
TILE_ROWS = 2000
FIRST = 2               # hashes of step 2
COMMON = 8              # of an eighth of the documents: a hash in so many documents goes last
MOST_COMMON = 1_000_000  # so many hashes at most (8 bytes each) go last, the most common ones
TILE = ("token", "band", "x", "y", "id", "n", "comp", "own", "s")


def grams_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text with fewer words is one n-gram."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = text.encode("utf-8", "replace").lower().split()     # bytes: only A-Z change; splits at 9-13 and 32
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = word_hasher()(w)
    if len(w) < words:
        return mixed(spans_hashed(h, len(w)) ^ np.uint64(len(w)))
    return np.unique(spans_hashed(h, words))


def n_bits(n: int) -> int:
    """Bitmap width of sets of up to ``n`` elements: a bit or two an element, 64 to 8192."""
    return min(8192, max(64, 1 << (n - 1).bit_length()))


def band_of(n: int, share: tuple[int, int] = SHARE) -> int:
    return int(math.log(n) / math.log(share[1] / share[0]) + 1e-9)


def bitmap(grams: np.ndarray, width: int) -> np.ndarray:
    on = np.zeros(width, dtype=np.uint8)
    on[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap brought down to ``width`` bits."""
    while len(bits) * 64 > width:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def partners(i: int, bits: np.ndarray, sizes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which of the rows before ``i`` may be similar to it, by sizes and bitmaps."""
    num, den = share
    n, m = sizes[i], sizes[:i]
    only_i = np.bitwise_count(bits[i] & ~bits[:i]).sum(axis=1, dtype=np.int64)
    only_j = np.bitwise_count(bits[:i] & ~bits[i]).sum(axis=1, dtype=np.int64)
    most = np.minimum(n - only_i, m - only_j)
    return (den * most >= num * (n + m - most)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def prefix_size(n: int, share: tuple[int, int]) -> int:
    return n - -(-share[0] * n // share[1]) + 1


def prefix_of(low: np.ndarray, n: int, share: tuple[int, int], common: np.ndarray) -> np.ndarray | None:
    """The prefix of a set of ``n`` hashes in the order "not common, common; by size", from
    its smallest ones; None if these do not settle it."""
    size = prefix_size(n, share)
    if not len(common):
        return low[:size]
    at = np.minimum(np.searchsorted(common, low), len(common) - 1)
    is_common = common[at] == low
    rare = low[~is_common]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, low[is_common][:size - len(rare)]]) if len(low) == n else None


def _prefixes(sent, share: tuple[int, int], words: int | None):
    """(id, n, tokens): prefixes from the smallest hashes, NULL where these do not settle
    them; with ``words`` from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if words is None:
                ids, sizes = b.column(0), b.column(1)
                flat = b.column(2).flatten().to_numpy().view(np.uint64)
                cut = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())]).tolist()
                lows = [flat[lo:hi] for lo, hi in zip(cut, cut[1:], strict=False)]
            else:
                lows = [grams_of(t, words) for t in b.column(1).to_pylist()]
                ids, sizes = b.column(0), pa.array([len(g) for g in lows], pa.int64())
            made = [prefix_of(g, n, share, sent.value) if n else None for g, n in zip(lows, sizes.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, sizes, pa.array([None if m is None else m.view(np.int64) for m in made], pa.list_(pa.int64()))],
                names=["id", "n", "tokens"])
    return run


def _sketches(words: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for b in batches:
            out = {k: [] for k in ("n", "f1", "f2", "low", "bits")}
            for t in b.column(1).to_pylist():
                g = grams_of(t, words)
                n = len(g)
                f1, f2 = np.frombuffer(xxh3_128_digest(g.tobytes()), dtype=np.int64).tolist()
                out["n"].append(n)
                out["f1"].append(f1)
                out["f2"].append(f2)
                # half as many again, for those that common ones make room for
                out["low"].append(g[:prefix_size(n, share) * 3 // 2].view(np.int64) if n else np.empty(0, np.int64))
                out["bits"].append(bitmap(g, n_bits(n)).tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out["n"], pa.int64()), pa.array(out["f1"], pa.int64()), pa.array(out["f2"], pa.int64()),
                 pa.array(out["low"], pa.list_(pa.int64())), pa.array(out["bits"], pa.binary())],
                names=["id", "n", "f1", "f2", "low", "bits"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([grams_of(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())],
                names=["id", "grams"])
    return run


def _tiles(rows: DataFrame, share: tuple[int, int], limit: int) -> DataFrame:
    """rows (token, id, n, comp, small) as (token, band, x, y, id, n, comp, own, s): the tiles that
    hold two components and a row that can be the smaller of a pair. Tiles of over ``limit`` rows are
    cut into blocks by id, and every pair of blocks is a tile. Keys are counted with
    map-side combining; nothing is dropped."""
    band = F.floor(F.log(F.col("n")) / math.log(share[1] / share[0]) + 1e-9).cast("int")
    both = rows.withColumn("_b", F.explode(F.array(F.struct(band.alias("band"), F.col("small").alias("own")),
                                                   F.struct((band - 1).alias("band"), F.lit(False).alias("own")))))
    both = both.select("token", "id", "n", "comp", "_b.band", "_b.own")
    kept = (both.groupBy("token", "band").agg(F.count(F.lit(1)).alias("_n"), F.max("own").alias("_own"),
                                              F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
            .where("_own AND _lo != _hi").select("token", "band", F.ceil(F.col("_n") / F.lit(limit)).alias("_k")))
    t = both.join(kept, ["token", "band"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    other = F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))
    return (t.withColumn("_o", F.explode(other))
            .select("token", "band", F.least("s", "_o").alias("x"), F.greatest("s", "_o").alias("y"), "id", "n", "comp", "own", "s"))


def _tile_arrays(t: pa.Table) -> tuple:
    ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
    order = np.lexsort((ids, n))
    pick = lambda c: t.column(c).to_numpy()[order]
    cross = t.column("x")[0].as_py() != t.column("y")[0].as_py()
    return order, ids[order], n[order], pick("comp"), t.column("own").to_numpy(zero_copy_only=False)[order], pick("s"), cross


def _forest(share: tuple[int, int], exact: bool):
    """Edges that connect what a tile's pairs connect and the rows' components do not yet.
    ``exact`` intersects the sets of the pairs that pass; else passing the bitmaps is enough."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 4):
            if t.num_rows < 2:
                continue
            order, ids, n, comp, own, s, cross = _tile_arrays(t)        # by size
            raw = t.column("grams" if exact else "bits").to_pylist()
            made = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
            if exact:
                n = np.array([len(g) for g in made])
                width = n_bits(int(np.median(n)))
                bits = np.stack([bitmap(g, width) for g in made])
            else:
                width = min(len(x) for x in made) * 64
                bits = np.stack([folded(x, width) for x in made])
            label = np.unique(comp, return_inverse=True)[1]
            a, b = [], []
            for i in range(1, len(ids)):
                may = (label[:i] != label[i]) & (own[:i] | own[i])
                if cross:
                    may &= s[:i] != s[i]
                if not may.any():
                    continue
                may &= partners(i, bits, n, share)
                while may.any():
                    j = i - 1 - int(may[::-1].argmax())         # the nearest in size first
                    if exact:
                        o = len(np.intersect1d(made[i], made[j], assume_unique=True))
                        if den * o < num * (len(made[i]) + len(made[j]) - o):
                            may[j] = False
                            continue
                    a.append(ids[i])
                    b.append(ids[j])
                    label[label == label[j]] = label[i]
                    may &= label[:i] != label[i]
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.array(a), "b": np.array(b)})
    return run


def _grouped(tiles: DataFrame) -> DataFrame:
    keys = ["token", "band", "x", "y"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: the root of their id in ``found``, or the id itself."""
    c = sendable(found.select(F.col("node").alias("id"), "root"))
    return rows.join(c, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _intersected(docs: DataFrame, clusters: DataFrame, words: int, share: tuple[int, int], tile_rows: int) -> DataFrame:
    """Edges (a, b) that connect the similar sets inside each cluster.

    A cluster of up to ``tile_rows`` rows is one tile. A larger one is cut into blocks by
    id: the blocks are intersected within; then one delegate of each component found meets
    the others, which joins the blocks of near copies; whatever clusters still have several
    components are compared block by block, components apart. Sets are made again from the
    texts of the documents concerned, and are never all in one place."""
    clusters = saved(clusters, "clustered")
    size = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("_k"))
    ids = sendable(clusters.select("id"))
    sets = saved(docs.join(ids, "id", "left_semi").mapInArrow(releasing(_sets(words)), "id long, grams binary"), "sets")
    placed = clusters.join(size, "cluster").select(
        F.col("cluster").alias("token"), F.lit(0).alias("band"), "id", "n", F.lit(True).alias("own"),
        F.pmod(F.xxhash64("id"), F.col("_k")).cast("int").alias("s"), "_k")

    def met(tiles: DataFrame) -> DataFrame:
        rows = tiles.join(sets, "id").select(*TILE, "grams")
        return saved(_grouped(rows).mapInArrow(releasing(_forest(share, True)), "a long, b long"), "links")

    x = F.col("s")
    found = met(placed.select("token", "band", x.alias("x"), x.alias("y"), "id", "n", F.col("id").alias("comp"), "own", "s"))
    cut = saved(placed.where("_k > 1"), "cut")
    if not cut.limit(1).count():
        return found
    zero = F.lit(0)
    some = _labelled(cut, saved(components(found), "parts"))
    one = (some.groupBy("token", "comp").agg(F.min_by(F.struct("id", "n"), "id").alias("_d"))
           .select("token", zero.alias("band"), "_d.id", "_d.n", "comp", F.lit(True).alias("own")))
    many = one.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("_m"))
    one = one.join(many, "token").withColumn("s", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    found = saved(found.union(met(one.select("token", "band", F.col("s").alias("x"), F.col("s").alias("y"),
                                             "id", "n", "comp", "own", "s"))), "links")
    some = saved(_labelled(cut, saved(components(found), "parts")), "cut")
    apart = some.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("token")
    left = some.join(apart, "token", "left_semi").withColumn("_o", F.explode(F.sequence(zero, (F.col("_k") - 1).cast("int"))))
    return found.union(met(left.select("token", "band", F.least("s", "_o").alias("x"), F.greatest("s", "_o").alias("y"),
                                       "id", "n", "comp", "own", "s")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
                       share: tuple[int, int] = SHARE, tile_rows: int = TILE_ROWS, common: int = COMMON) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles (long), component_id (long).

    Two sets are linked when ``share[1] * |intersection| >= share[0] * |union|``;
    component_id is the smallest id that links reach, the row's own without any.

    * NULL, empty or blank text: set size 0, linked with nothing.
    * NULL id: the set size is given, component_id is NULL, and it is linked with nothing.
    * Rows that repeat an id are one node, with all their sets; each row keeps its own set size.
    * Integer ids. Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sk = saved(d.mapInArrow(releasing(_sketches(words, share)), "id long, n long, f1 long, f2 long, low array<long>, bits binary"),
               "sketches")
    live = sk.where("n > 0 AND id IS NOT NULL")
    classes = live.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    member = saved(live.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).distinct(), "members")
    copies = member.where("id != rep").select("id", "n", "f1", "f2")
    reps = live.join(sendable(copies), ["id", "n", "f1", "f2"], "left_anti")
    signs = reps.select("id", "n", "bits")

    def clustered(rows: DataFrame) -> DataFrame:
        """Candidate edges among rows (token, id, n, comp, small), by bitmaps."""
        signed = _tiles(rows, share, tile_rows * 8).join(signs, ["id", "n"]).select(*TILE, "bits")
        return saved(_grouped(signed).mapInArrow(releasing(_forest(share, False)), "a long, b long"), "candidates")

    # an eighth of the documents shows which hashes are common
    eighth = reps.where(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(8)) == 0).select(F.explode("low").alias("token"))
    last = (eighth.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= common)
            .orderBy(F.desc("_n"), "token").limit(MOST_COMMON).select("token").toPandas()["token"])
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(last.to_numpy(dtype=np.int64).view(np.uint64)))
    schema = "id long, n long, tokens array<long>"
    settled = reps.select("id", "n", "low").mapInArrow(releasing(_prefixes(sent, share, None)), schema)
    open_ids = saved(settled.where("tokens IS NULL").select("id").distinct(), "open")
    texts = saved(d.join(sendable(open_ids), "id", "left_semi").mapInArrow(releasing(_prefixes(sent, share, words)), schema), "texts")
    prefixes = settled.where("tokens IS NOT NULL").union(texts.where("tokens IS NOT NULL"))
    # The smaller of a pair has the first hash they share earlier than its prefix ends: the
    # overlap has to be the share 2t / (1 + t) of its size, and what stands before is not in it.
    num, den = share
    small = (F.col("_at") <= F.col("n") - F.ceil(F.col("n") * (2 * num) / F.lit(num + den) - 1e-9)).alias("small")
    first = (prefixes.select("id", "n", F.posexplode(F.slice("tokens", 1, FIRST)).alias("_at", "token"))
             .select("id", "n", "token", small))
    found = clustered(first.withColumn("comp", F.col("id")))
    every = _labelled(prefixes.select("id", "n", F.posexplode("tokens").alias("_at", "token"))
                      .select("id", "n", "token", small), saved(components(found), "clusters"))
    shared = every.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("token")
    # few of the prefixes' hashes are shared: the others are dropped where they stand
    left = saved(every.join(sendable(saved(shared, "shared")), "token", "left_semi"), "left")
    found = found.union(clustered(left))
    cluster = saved(components(found), "clusters")
    links = _intersected(d, reps.select("id", "n").join(cluster, F.col("id") == F.col("node")).select("id", "n", F.col("root").alias("cluster")),
                         words, share, tile_rows)
    # rows that repeat an id with different texts are one node
    again = member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(links.union(again))
    out = sk.select("id", "n").join(comp, sk["id"] == comp["node"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("root", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that link to a smaller id; of rows that repeat an id the one
    whose text sorts first stays. Rows with a NULL id stay."""
    found = saved(jaccard_components(docs, id_col, text, **how).select(
        F.col(id_col).alias("_one_id"), "component_id"), "groups")
    lost = sendable(found.where("component_id != _one_id").select("_one_id").distinct())
    left = docs.join(lost, F.col(id_col) == F.col("_one_id"), "left_anti")
    again = saved(found.where("_one_id IS NOT NULL").groupBy("_one_id").agg(F.count(F.lit(1)).alias("_n"))
                  .where("_n > 1").select("_one_id"), "again")
    if not again.limit(1).count():
        return left
    twice = sendable(again)
    same = F.col(id_col) == F.col("_one_id")
    cols = [f"`{c}`" for c in docs.columns]
    first = Window.partitionBy(id_col).orderBy(F.col(text).asc_nulls_last())
    kept = left.join(twice, same, "left_semi").withColumn("_one_n", F.row_number().over(first)).where("_one_n = 1")
    return left.join(twice, same, "left_anti").select(*cols).union(kept.select(*cols))
