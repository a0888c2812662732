"""Embedding near-duplicates by spherical-cap filters.

Filter directions are random product codes: after a seeded rotation the space is cut into
``blocks``, each with its own code of random vectors, and a direction is one code vector
from each block. A vector passes a filter when its inner product with the direction
reaches ``alpha``. List-decoding finds all passed filters of a vector without visiting
the others: block by block, a partial sum goes on only while the largest products of the
blocks to come could still lift it to ``alpha``.

Vectors are joined on their filters, and every pair within a filter is verified. A pair
that shares several filters is counted in the smallest. What travels with each filter is a
sketch, the unit vector in 16-bit steps, with the length of what the rounding left off: two
such lengths bound the error of a sketched cosine, so most pairs are decided by the sketch
alone. The few within the bound are fetched once and decided in double precision.

``alpha`` and the code sizes follow from the number of vectors (see :func:`plan`), so
that a filter holds about ``per_filter`` unrelated vectors and a vector passes about
``passed`` filters of a code at every size. As caps narrow with the number of vectors, a
pair shares fewer filters of one code; :func:`plans` adds independent codes until pairs at
exactly the wanted cosine are found as often as asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, runs, saved

COSINE = 0.9
SEED = 4
TILE_ROWS = 1000
RECALL = 0.99       # of pairs at exactly the cosine
MOST_CODES = 64
STEPS = 32767       # of a sketch's largest component
ROUNDING = 1e-9     # more than double arithmetic loses in a product
PASSED = 10         # filters of one code that a vector passes, where codes are added


class Plan(NamedTuple):
    dim: int
    blocks: int
    code: int       # vectors in each block's code
    alpha: float
    seed: int


def plan(n: int, dim: int, cosine: float = COSINE, per_filter: int = 32, passed: int = 40, seed: int = SEED) -> Plan:
    """Filter parameters for ``n`` distinct vectors: a filter takes the share ``per_filter / n``
    of random directions (a cap of the sphere), but in few dimensions never a cap narrower
    than the angle of the pairs that are looked for; and there are enough filters that a
    vector passes ``passed`` of them."""
    angle = np.linspace(0.0, math.pi, 200_001)
    ring = np.sin(angle) ** max(dim - 2, 0)
    cap = np.cumsum(ring) / ring.sum()                      # share of the sphere inside each angle
    wanted = min(0.02, max(per_filter / max(n, 1), 1e-9))
    width = max(float(angle[np.searchsorted(cap, wanted)]), math.acos(cosine))
    share = float(cap[np.searchsorted(angle, width)])
    blocks = 2 if dim >= 16 else 1
    return Plan(dim, blocks, max(2, math.ceil((passed / share) ** (1 / blocks))), math.cos(width), seed)


def plans(n: int, dim: int, cosine: float = COSINE, recall: float = RECALL, pairs: int = 1000) -> list[Plan]:
    """Independent plans (other seeds) that together find ``recall`` of random pairs at exactly
    ``cosine``: codes are added until no more of ``pairs`` drawn pairs are missed."""
    p = plan(n, dim, cosine, passed=PASSED)
    if dim < 2:
        return [p]
    rng = np.random.default_rng([p.seed, 1])
    x, y = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine ** 2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    out, lost = [], np.arange(pairs)
    while not out or len(lost) > (1 - recall) * pairs:
        if len(out) == MOST_CODES:
            raise ValueError(f"{MOST_CODES} codes find {1 - len(lost) / pairs:.3f} of the pairs, {recall} is asked for")
        out.append(p._replace(seed=p.seed + 7919 * len(out)))
        codes = Codes(out[-1])
        shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in
                  zip(codes.decode(x[lost]), codes.decode(y[lost]), strict=True)]
        lost = lost[np.array(shared) == 0]
    return out


class Codes:
    """The rotation and the blocks' codes of a plan; every task draws the same ones."""

    def __init__(self, p: Plan):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.rotation = np.linalg.qr(rng.standard_normal((p.dim, p.dim)))[0]
        self.cut = [p.dim * k // p.blocks for k in range(p.blocks + 1)]
        self.codes = []
        for lo, hi in zip(self.cut, self.cut[1:], strict=False):
            c = rng.standard_normal((p.code, hi - lo))
            self.codes.append(c * math.sqrt((hi - lo) / p.dim) / np.linalg.norm(c, axis=1, keepdims=True))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters that it passes, ascending."""
        y = x @ self.rotation
        products = [y[:, lo:hi] @ c.T for (lo, hi), c in
                    zip(zip(self.cut, self.cut[1:], strict=False), self.codes, strict=True)]
        tops = [q.max(axis=1) for q in products]
        out = []
        for i in range(len(x)):
            number, total = np.zeros(1, dtype=np.int64), np.zeros(1)
            for k, q in enumerate(products):
                rest = sum(t[i] for t in tops[k + 1:])
                all_of = total[:, None] + q[i][None, :]
                a, b = np.nonzero(all_of >= self.p.alpha - rest - (1e-12 if rest else 0))
                number, total = number[a] * self.p.code + b, all_of[a, b]
            out.append(np.sort(number))
        return out


_CODES: dict[tuple[Plan, ...], list[Codes]] = {}


def _codes(ps: tuple[Plan, ...]) -> list[Codes]:
    if ps not in _CODES:
        _CODES.clear()
        _CODES[ps] = [Codes(p) for p in ps]
    return _CODES[ps]


def _decoded(codes: list[Codes], x: np.ndarray) -> list[np.ndarray]:
    """The filters of all codes that each vector passes, ascending; each code has numbers of its own."""
    first = np.cumsum([0, *(c.p.code ** c.p.blocks for c in codes)])
    return [np.concatenate(own) for own in zip(*([n + lo for n in c.decode(x)] for c, lo in zip(codes, first, strict=False)),
                                               strict=True)]


def _scaled(kind: str):
    """(id, vec) with the vector as bytes of ``kind``, its largest component scaled to 0.5 to 1 by a
    power of two, which rounds nothing; NULL for vectors that cannot be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = None if v is None or not v or any(c is None for c in v) else np.array(v, dtype=np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    out.append(None)
                    continue
                x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])      # no overflow in the squares
                out.append((x + 0.0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])
    return run


def _stacked(raw: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(r, dtype=kind) for r in raw.to_pylist()]).astype(np.float64)


def _number_type(ps: tuple[Plan, ...]) -> str:
    """Filter numbers travel with every row of a tile, as narrow as they can be."""
    return "int" if sum(p.code ** p.blocks for p in ps) < 1 << 31 else "long"


def _sketched(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit steps of unit vectors, the step of each vector, and how far its sketch is from it."""
    step = np.abs(x).max(axis=1) / STEPS
    q = np.rint(x / step[:, None]).astype("<i2")
    return q, step, np.linalg.norm(x - q * step[:, None], axis=1)


def _decoder(ps: tuple[Plan, ...], kind: str):
    number = pa.int32() if _number_type(ps) == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(ps)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = _stacked(b.column("vec").slice(lo, 512), kind)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                q, step, off = _sketched(x)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, len(x)) for c in ("id", "copies")),
                     pa.array([r.tobytes() for r in q], pa.binary()), pa.array(step), pa.array(off),
                     pa.array(_decoded(codes, x), pa.list_(number))],
                    names=["id", "copies", "sketch", "step", "off", "filters"])
    return run


def _least_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``ids`` reaches by the links between places ``i`` and ``j``."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    i, j = rank[i], rank[j]
    up = np.arange(len(ids))
    while (up[i] != up[j]).any():
        a, b = up[i], up[j]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))   # a root hangs below a smaller one
        while (up != up[up]).any():
            up = up[up]
    return ids[order][up[rank]]


def _verified(cosine: float):
    """Of each tile: for every vector the linked others (weighted by copies) that this tile
    counts, and an edge to the smallest id that the tile's links reach from it; the nearest
    smaller one alone would leave a vector apart whose links are all to larger ids that have
    smaller ones. A pair that the sketches leave open is a row of its own without a count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
            if len(ids) < 2:
                continue
            x, y = (t.column(c)[0].as_py() for c in ("x", "y"))
            sketch = np.stack([np.frombuffer(r, dtype="<i2") for r in t.column("sketch").to_pylist()])
            sketch = sketch * t.column("step").to_numpy()[:, None]
            product = sketch @ sketch.T
            off = float(t.column("off").to_numpy().max())
            bound = 2 * off + off * off + ROUNDING      # x.y - x'.y' = (x - x').y + x'.(y - y')
            near = product >= cosine - bound
            side = t.column("s").to_numpy()
            near &= (side[:, None] != side[None, :]) if x != y else ~np.eye(len(ids), dtype=bool)
            i, j = np.nonzero(np.triu(near))
            if not len(i):
                continue
            lists = t.column("filters").to_pylist()
            # a pair counts in the smallest filter that both pass; a row has those below the tile's own
            smaller = [frozenset(one) for one in lists]
            first = np.fromiter((smaller[a].isdisjoint(smaller[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)),
                                dtype=bool, count=len(i))
            i, j = i[first], j[first]
            if not len(i):
                continue
            sure = product[i, j] >= cosine + bound
            if not sure.all():
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[~sure]]), pa.nulls(int((~sure).sum()), pa.int64()),
                                                  pa.array(ids[j[~sure]])], names=["id", "links", "least"])
                i, j = i[sure], j[sure]
            n = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
            least = _least_reached(ids, i, j)
            has = n > 0
            yield pa.RecordBatch.from_pydict({"id": ids[has], "links": n[has].astype(np.int64), "least": least[has]})
    return run


def _settled(cosine: float, kind: str):
    """Pairs that sketches left open, decided in double precision on the vectors as given (the
    product of rounded unit vectors falls short of a cosine that is met exactly); of a link one
    row for each end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_stacked(b.column(c), kind) for c in ("a_vec", "b_vec"))
            xy, xx, yy = (np.einsum("ij,ij->i", u, v) for u, v in ((x, y), (x, x), (y, y)))
            near = xy / np.sqrt(xx * yy) >= cosine
            a, b_, na, nb = (b.column(c).to_numpy()[near] for c in ("a", "b", "a_copies", "b_copies"))
            least = np.minimum(a, b_)
            yield pa.RecordBatch.from_pydict({"id": np.concatenate([a, b_]), "links": np.concatenate([nb, na]),
                                              "least": np.concatenate([least, least])})
    return run


def _verify(rows: DataFrame, rep: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(id, links, least) over the tiles in ``rows``; ``rep`` (rep, vec, copies) has the whole vectors."""
    found = saved(rows.repartition("filter", "x", "y").sortWithinPartitions("filter", "x", "y")
                  .mapInArrow(_verified(cosine), "id long, links long, least long"), "verified")
    end = lambda c: rep.select(F.col("rep").alias(c), F.col("vec").alias(f"{c}_vec"), F.col("copies").alias(f"{c}_copies"))
    pairs = found.where("links IS NULL").select(F.col("id").alias("a"), F.col("least").alias("b"))
    settled = pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(_settled(cosine, kind), "id long, links long, least long")
    return found.where("links IS NOT NULL").union(saved(settled, "settled"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    tile_rows: int = TILE_ROWS, p: Plan | None = None) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links (other vectors linked directly),
    component_id (smallest id that links reach, itself included), kept (id = component_id).

    * Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with
      nothing: 0 links, a component of their own, kept. So do vectors whose length is not
      that of the first comparable one by id.
    * Equal vectors (a third of the table, say), powers of two apart or not, are compared once;
      their copies count as links of each other and of whatever links with them, and are not
      expanded to pairs.
    * NULL ids: 0 links, component_id and kept NULL. Rows that repeat an id count as copies.
    * A filter with more than ``tile_rows`` vectors becomes tiles of pairs of its blocks.
    * An empty table gives an empty result. Other columns are not read.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    kind = "<f4" if every.schema["v"].dataType.elementType == FloatType() else "<f8"
    whole = saved(every.mapInArrow(_scaled(kind), "id long, vec binary"), "scaled")
    live = whole.where("id IS NOT NULL AND vec IS NOT NULL")
    first = live.orderBy("id").select(F.octet_length("vec")).first()
    if first is None:
        none = whole.select("id").withColumn("links", F.lit(0).cast("long")).withColumn("root", F.col("id"))
    else:
        size = first[0]
        live = live.where(F.octet_length("vec") == size)
        rep = saved(live.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "rep")
        ps = (p,) if p else tuple(plans(rep.count(), size // np.dtype(kind).itemsize, cosine))
        coded = saved(rep.select(F.col("rep").alias("id"), "copies", "vec").repartition("id").mapInArrow(
            _decoder(ps, kind), "id long, copies long, sketch binary, step double, off double, "
            f"filters array<{_number_type(ps)}>"), "coded")
        passed = coded.select("id", F.explode("filters").alias("filter"))
        held = passed.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_k"),
                                            F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        placed = passed.join(held, "filter").withColumn("s", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
        tiles = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
            "filter", F.least("s", "_o").alias("x"), F.greatest("s", "_o").alias("y"), "id", "s")
        rows = tiles.join(coded, "id").select("filter", "x", "y", "id", "s", "copies", "sketch", "step", "off",
                                               F.filter("filters", lambda f: f < F.col("filter")).alias("filters"))
        found = _verify(rows, rep, cosine, kind)
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        root = components(found, "id", "least")
        of_rep = (rep.join(links, rep["rep"] == links["id"], "left").drop("id")
                  .join(root, F.col("rep") == F.col("node"), "left")
                  .select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                          F.coalesce("root", "rep").alias("root")))
        none = whole.join(of_rep.withColumnRenamed("vec", "_v"), (F.col("vec") == F.col("_v")) & F.col("id").isNotNull(), "left").select(
            "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    return none.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("root").alias("component_id"),
                       (F.col("id") == F.col("root")).alias("kept"))
