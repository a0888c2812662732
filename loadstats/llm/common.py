"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: What separates words in every operator here: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; a NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives
    lost executors, and branches that read it do not run what stands above it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone: what else a table carries cannot clash with working columns."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def running_offsets(counts: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all smaller ``key`` (a unique long >= 0).

    Two levels: inside blocks of ``block`` keys, then over the blocks, so that no task
    holds more than ``block`` rows until there are ``block`` squared keys."""
    blocked = counts.withColumn("_blk", F.floor(F.col(key) / F.lit(block)))
    sums = blocked.groupBy("_blk").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off_blk"))
    inside = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (blocked.withColumn("_off_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(bases, "_blk").withColumn(out, F.col("_off_in") + F.col("_off_blk")).drop("_blk", "_off_in", "_off_blk"))


def _joined(batches):
    """The components of few edges, by union-find in one task."""
    import pyarrow as pa
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    same = Unions(len(nodes))
    for i, j in zip(at[:len(u)].tolist(), at[len(u):].tolist(), strict=True):
        same.join(i, j)
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[same.roots()]})


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64,
               few_edges: int = 200_000) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Up to ``few_edges`` edges (16 bytes each) one task joins them. More are never in one
    place: large stars and small stars alternate until nothing changes, each round written
    to the shared folder. Only the edge count of a round comes to the driver. A hub is
    an aggregate with map-side combining and a join that adaptive execution can split."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = both.join(least, "u")
        if large:
            out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "cc")
    if e.limit(few_edges + 1).count() <= few_edges:
        return e.coalesce(1).mapInArrow(_joined, "node long, root long")
    seen = None
    for _ in range(most_rounds):
        e = saved(star(star(e, True), False), "cc")
        now = digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.groupBy("v").agg(F.min("v").alias("root")).select(F.col("v").alias("node"), "root"))


class Unions:
    """Union-find over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return nxt
            up = nxt




def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Whole texts travel to Python in Arrow batches of at most ``rows`` rows and about
    ``megabytes`` MB (a longer text is a batch of its own). The session keeps these settings."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = spark.conf.get(key).rstrip("b")                   # sizes are shown as 8388608b
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


_STORES: list = []


def forgettable(store):
    """Registers a store that lives as long as the Python worker (it has ``forget()``)."""
    _STORES.append(store)
    return store


def releasing(run):
    """``run`` (batches to batches) that leaves its worker small: a worker outlives its task and
    is used again by other stages, so stores are emptied and freed memory goes back."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa
            for s in _STORES:
                s.forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc
            if trim is not None:
                trim(0)
    return tidy


class WordHasher:
    """Two independent 64-bit hashes of the words of a text; each distinct word is hashed once
    while it is held. Words of up to ``most_bytes`` bytes in all are held."""

    def __init__(self, seed: int = 0, most_held: int = 150_000, most_bytes: int = 8 << 20):
        from xxhash import xxh3_128_digest
        self._hash, self._seed, self._most, self._most_bytes = xxh3_128_digest, seed, most_held, most_bytes
        self.forget()

    def forget(self) -> None:
        self._row: dict[bytes, int] = {}
        self._value = np.empty((1 << 14, 2), dtype=np.uint64)
        self._bytes = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.both(words)[:, 0]

    def both(self, words: list[bytes]) -> np.ndarray:
        if len(self._row) > self._most or self._bytes > self._most_bytes:
            self.forget()
        row = self._row
        at = np.fromiter(map(row.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            late = [words[i] for i in new]
            fresh = list(dict.fromkeys(late))
            n = len(row)
            while len(self._value) < n + len(fresh):
                self._value = np.concatenate([self._value, np.empty_like(self._value)])
            self._value[n:n + len(fresh)] = np.frombuffer(
                b"".join([self._hash(w, self._seed) for w in fresh]), dtype=np.uint64).reshape(-1, 2)
            self._bytes += sum(map(len, fresh))
            row.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            at[new] = [row[w] for w in late]
        return self._value[at]


_HASHER: list[WordHasher] = []


def word_hasher() -> WordHasher:
    """The worker's one hasher."""
    if not _HASHER:
        _HASHER.append(forgettable(WordHasher()))
    return _HASHER[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit numbers (bijective)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hashed(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mixed(out + h[j:j + n] + np.uint64(2 * j + 1))
    return out


def runs(batches, keys: int):
    """Record batches sorted by their first ``keys`` (integer) columns, as one table a key."""
    import pyarrow as pa
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(t.num_rows - 1, dtype=bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cut = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest


def sendable(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` (a few numbers a row) marked for broadcasting if it has at most ``most_rows``
    rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


class HeldIds:
    """Ids of words, held in flat arrays: word -> row -> ids."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.start = np.empty(1 << 14, dtype=np.int64)
        self.size = np.empty(1 << 14, dtype=np.int64)
        self.used = 0

    def __len__(self) -> int:
        return len(self.row)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        while len(a) < n:
            a = np.concatenate([a, np.empty_like(a)])
        return a

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Takes new words with their ids one after the other; returns their rows."""
        at, n = len(self.row), len(words)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.start, self.size = self._room(self.start, at + n), self._room(self.size, at + n)
        self.ids[self.used:self.used + len(ids)] = ids
        self.size[at:at + n] = sizes
        self.start[at:at + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.row.update(zip(words, range(at, at + n), strict=True))
        return np.arange(at, at + n)

    def rows(self, words: list[str], learn) -> np.ndarray:
        """The words' rows; ``learn(list of new words)`` has to add those that are not held."""
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            late = [words[i] for i in new]
            learn(list(set(late)))
            rows[new] = np.fromiter(map(self.row.__getitem__, late), dtype=np.int64, count=len(late))
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and how many each has."""
        size = self.size[rows]
        ends = np.cumsum(size)
        if not len(rows):
            return np.empty(0, np.int32), size
        at = np.repeat(self.start[rows] - (ends - size), size)
        at += np.arange(ends[-1])
        return self.ids[at], size
