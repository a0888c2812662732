"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; filters of ``WIDTH`` bytes slide over them two bytes
at a time. The outputs are max-pooled over chunks of 256 bytes that overlap by 64 and
cover the whole text. The mean, the largest and the smallest of each filter over the
chunks go through one hidden layer to one probability.

The network is fitted on the driver from a bounded sample; scoring runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .language_id import split_number

PER_CLASS = 800        # documents of each label that the network is fitted on, at most
WIDTH, STEP, EMBED, FILTERS, HIDDEN = 12, 2, 6, 32, 16
BLOCK, CHUNK, HOP = 32, 4, 3      # filter places in a block; blocks in a chunk; blocks from one chunk to the next
SLAB = 512 * BLOCK      # filter places computed at once


class ByteCNN:
    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"embed": f(256, EMBED, scale=0.5), "conv": f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
                  "conv0": np.zeros(FILTERS, np.float32), "hid": f(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
                  "hid0": np.zeros(HIDDEN, np.float32), "out": f(HIDDEN, scale=HIDDEN ** -0.5),
                  "out0": np.zeros((), np.float32)}

    def _places(self, raw: bytes) -> np.ndarray:
        """Bytes, padded with zeros so that filter places fill whole steps."""
        n = max(len(raw), WIDTH)
        n += (n - WIDTH) % STEP
        b = np.zeros(n, dtype=np.uint8)
        b[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        return b

    def _blocks(self, b: np.ndarray, want_at: bool = False):
        """Largest output of each filter in each block of places, and where it is."""
        n = (len(b) - WIDTH) // STEP + 1
        x = self.p["embed"][b]
        best, at = [], []
        for lo in range(0, n, SLAB):
            hi = min(n, lo + SLAB)
            windows = np.lib.stride_tricks.as_strided(
                x[lo * STEP:], (hi - lo, WIDTH * EMBED), (STEP * EMBED * 4, 4))
            y = windows @ self.p["conv"]
            short = -(hi - lo) % BLOCK
            if short:
                y = np.concatenate([y, np.full((short, FILTERS), -np.inf, np.float32)])
            y = y.reshape(-1, BLOCK, FILTERS)
            if want_at:
                k = y.argmax(axis=1)
                best.append(np.take_along_axis(y, k[:, None], axis=1)[:, 0])
                at.append(k + (lo + np.arange(len(k)) * BLOCK)[:, None])
            else:
                best.append(y.max(axis=1))
        return np.concatenate(best), np.concatenate(at) if want_at else None

    @staticmethod
    def _chunks(blocks: np.ndarray, want_at: bool = False):
        starts = np.arange(0, max(1, len(blocks) - (CHUNK - HOP)), HOP)
        which = np.minimum(starts[:, None] + np.arange(CHUNK), len(blocks) - 1)
        held = blocks[which]
        return held.max(axis=1), (np.take_along_axis(which[:, :, None], held.argmax(axis=1)[:, None], axis=1)[:, 0]
                                  if want_at else None)

    def _head(self, chunks: np.ndarray) -> tuple:
        a = np.maximum(chunks + self.p["conv0"], 0)
        v = np.concatenate([a.mean(axis=0), a.max(axis=0), a.min(axis=0)])
        h = np.maximum(v @ self.p["hid"] + self.p["hid0"], 0)
        return a, v, h, float(h @ self.p["out"] + self.p["out0"])

    def score(self, text: str | None) -> float:
        """Probability of label 1; 0 for a NULL or empty text."""
        if not text:
            return 0.0
        blocks, _ = self._blocks(self._places(text.encode("utf-8", "replace")))
        z = self._head(self._chunks(blocks)[0])[3]
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    def _gradients(self, b: np.ndarray, label: float, weight: float, g: dict) -> None:
        p = self.p
        blocks, place = self._blocks(b, True)
        chunks, block = self._chunks(blocks, True)
        a, v, h, z = self._head(chunks)
        d = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label))
        g["out"] += d * h
        g["out0"] += d
        dh = d * p["out"] * (h > 0)
        g["hid"] += np.outer(v, dh)
        g["hid0"] += dh
        dv = p["hid"] @ dh
        c, cols = len(a), np.arange(FILTERS)
        da = np.tile(dv[:FILTERS] / c, (c, 1))
        da[a.argmax(axis=0), cols] += dv[FILTERS:2 * FILTERS]
        da[a.argmin(axis=0), cols] += dv[2 * FILTERS:]
        da *= a > 0
        g["conv0"] += da.sum(axis=0)
        rows, filters = np.nonzero(da)
        if not len(rows):
            return
        at = place[block[rows, filters], filters] * STEP
        seen = b[at[:, None] + np.arange(WIDTH)]                   # bytes under each winning filter
        dy = da[rows, filters]
        x = p["embed"][seen].reshape(len(rows), -1) * dy[:, None]
        order = np.argsort(filters, kind="stable")
        first = np.flatnonzero(np.diff(filters[order], prepend=-1))
        g["conv"][:, filters[order][first]] += np.add.reduceat(x[order], first, axis=0).T
        dx = (p["conv"].T[filters] * dy[:, None]).reshape(-1, EMBED)
        for k in range(EMBED):
            g["embed"][:, k] += np.bincount(seen.ravel(), weights=dx[:, k], minlength=256).astype(np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = 10, batch: int = 16, rate: float = 0.004,
            cuts: float = 0.2, seed: int = 10) -> ByteCNN:
        """Adam on the mean log loss, both labels weighing the same.

        A text of label 1 is shown as a short cut of itself with probability ``cuts``:
        a text is not worse for being short."""
        rng = np.random.default_rng(seed)
        places = [self._places(t.encode("utf-8", "replace")) for t in texts]
        y = np.array(labels)
        n1 = max(1, int(y.sum()))
        weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * max(1, len(y) - n1)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(places))
            for lo in range(0, len(order), batch):
                some = order[lo:lo + batch]
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                for i in some:
                    b = places[i]
                    if y[i] and rng.random() < cuts:
                        n = int(rng.integers(14, 120))
                        lo_b = int(rng.integers(0, max(1, len(b) - n)))
                        b = self._places(b[lo_b:lo_b + n].tobytes())
                    self._gradients(b, float(y[i]), float(weight[i]) / len(some), g)
                step += 1
                r = rate * (1 - epoch / epochs)
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = (v - r * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                    label: str = "quality", may_learn: Column | None = None,
                    per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """Up to ``per_class`` whole texts of each label: those with the smallest hashed ids.

    NULL ids or texts and labels other than 0 and 1 teach nothing, nor do ids labelled both ways."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    rows = rows if may_learn is None else rows.where(may_learn)
    one = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id")
    chosen = one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_class).select("_id", "_y")
    got = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x")).where("_x IS NOT NULL")
           .join(F.broadcast(chosen), "_id").select("_id", "_x", "_y").collect())   # <= 2 x per_class ids
    got = sorted((r["_id"], r["_x"], r["_y"]) for r in got)
    return [r[1] for r in got], [r[2] for r in got]


def classify(docs: DataFrame, model: ByteCNN, text: str = "text", cut: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``cut``) added; columns of
    these names are replaced. NULL and empty texts score 0; every text is read whole, in
    slabs, so memory does not follow its length. Rows are judged alone: ties, repeats and
    NULLs elsewhere do not matter."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)     # a few thousand numbers

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sent.value.score(t) for t in batch], dtype="float64")

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*rest, F.pandas_udf(judge, "double")(F.col(f"`{text}`")).alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The network fitted outside the held-out quarter of ids, and every document's score.

    Without learnable rows the network stays as it was drawn."""
    part = split_number(F.col("doc_id"), 4)
    texts, y = labelled_sample(docs, labels, may_learn=part != 2)
    model = ByteCNN().fit(texts, y) if texts else ByteCNN()
    held = docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    return classify(held, model).select("doc_id", "held_out", "score", "predicted")
