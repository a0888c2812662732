"""Toxicity: a bag of subword embeddings, averaged, and a linear softmax, trained together.

A word is lower-cased, put between ``<`` and ``>`` and stands for its character n-grams of
3 to 6 code points and for itself. Each is hashed to one of ``BUCKETS`` embeddings; their
mean is the word's vector, and the mean of a text's word vectors and of ``BLANKS`` zero
vectors (so that a handful of words is weak evidence) goes through a linear softmax. A misspelt word shares most n-grams with the word it stems from, so it lies near
that word's vector though it was never seen.

Embeddings and softmax are fitted on the driver from a bounded sample; texts are scored
whole in tasks. Because everything after the hashing is linear, scoring needs one number
an n-gram: its embedding times the difference of the two softmax rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .language_id import split_number

PER_CLASS = 1500            # documents of each label that the model is fitted on, about
MOST_CHARS = 50_000         # code points of a document that the model is fitted on, at most
BUCKETS, DIM = 1 << 18, 8
SIZES = (3, 4, 5, 6)
BLANKS = 40                 # words without meaning that every average includes
CUT = 0.3
SLAB = 1 << 17              # code points scored at once
_GAPS = np.zeros(128, bool)
_GAPS[[*range(33), *map(ord, ".,;:!?\"()[]{}")]] = True


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's words, each between < and >: (code points, first places, lengths).

    Words end at white space, control characters and punctuation."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    gap = np.ones(len(c) + 2, bool)
    gap[1:-1] = np.where(c < 128, _GAPS[np.minimum(c, 127)], (c == 0xA0) | (c == 0x3000) | ((c >= 0x2000) & (c <= 0x200F)))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    n = size + 2
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    out[first], out[first + n - 1] = ord("<"), ord(">")
    inner = np.ones(len(out), bool)
    inner[first] = inner[first + n - 1] = False
    out[inner] = c[~gap[1:-1]]
    return out, first, n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def subwords(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, weight) of every n-gram and word of a text, and its number of words. The
    weights of one word's n-grams sum to 1."""
    c, first, n = word_places(text)
    if not len(n):
        return np.empty(0, np.int64), np.empty(0, np.float32), 0
    grams = np.ones(len(n), np.int64)                       # the word itself
    for k in SIZES:
        grams += np.maximum(n - k + 1, 0)
    share = (1.0 / grams).astype(np.float32)
    left = np.repeat(first + n, n) - np.arange(len(c))      # code points to the end of the word
    share_at = np.repeat(share, n)
    h = np.zeros(len(c), np.uint32)
    rows, weights = [], []
    for k in range(1, max(SIZES) + 1):
        h = h[:len(c) - k + 1]
        h = _mix((h + c[k - 1:] + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B))
        if k in SIZES:
            whole = left[:len(h)] >= k
            rows.append(h[whole])
            weights.append(share_at[:len(h)][whole])
    # the word: a sum of its code points, each mixed with its place
    place = (np.arange(len(c)) - np.repeat(first, n)).astype(np.uint32)
    word = np.add.reduceat(_mix(_mix(c + np.uint32(0x51ED270B)) + place * np.uint32(0xC2B2AE35)), first)
    rows.append(_mix(word.astype(np.uint32) * np.uint32(0x27D4EB2F)))
    weights.append(share)
    return (np.concatenate(rows) % np.uint32(buckets)).astype(np.int64), np.concatenate(weights), len(n)


class SubwordSoftmax:
    def __init__(self, buckets: int = BUCKETS, dim: int = DIM):
        self.embed = np.zeros((buckets, dim), np.float32)
        self.out = np.zeros((2, dim), np.float32)
        self.bias = np.zeros(2, np.float32)
        self._slope: np.ndarray | None = None

    def _bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct buckets and their weights, which sum to words / (words + BLANKS)."""
        row, weight, words = subwords(text, len(self.embed))
        if not words:
            return row, weight
        rows, at = np.unique(row, return_inverse=True)
        return rows, (np.bincount(at, weights=weight) / (words + BLANKS)).astype(np.float32)

    def fit(self, texts: list[str], labels: list[int], weights: list[float] | None = None, epochs: int = 9,
            rate: float = 0.05, alpha: float = 1.0, sparse: float = 0.7, l2: float = 0.01, least_texts: int = 5,
            scale: float = 100.0, seed: int = 13) -> SubwordSoftmax:
        """Embeddings and softmax together by online gradients of the weighted log loss.

        Embeddings follow the regularised leader (FTRL-proximal): an n-gram's steps shrink with
        the root of its own squared gradients, and its vector stays zero until the length of
        its summed gradient passes ``sparse``, so n-grams that fit single texts only are
        left out. N-grams of fewer than ``least_texts`` texts are not learned. The softmax
        rows start at random, opposite each other, and take plain gradient steps."""
        rng = np.random.default_rng(seed)
        y = np.asarray(labels)
        w = np.ones(len(y)) if weights is None else np.asarray(weights)
        bags = [self._bag(t) for t in texts]
        held = np.zeros(len(self.embed), np.int64)
        for rows, _ in bags:
            held[rows] += 1
        often = held >= least_texts
        bags = [(rows[often[rows]], share[often[rows]] * np.float32(scale)) for rows, share in bags]
        one = rng.standard_normal(self.out.shape[1]).astype(np.float32)
        one /= 2 * np.sqrt(one @ one)
        self.out = np.stack([-one, one])
        self.bias = np.log(np.maximum([w[y == 0].sum(), w[y == 1].sum()], 1e-9) / w.sum()).astype(np.float32)
        pull = np.zeros_like(self.embed)                        # summed gradients, less what the steps took back
        square = np.zeros(len(self.embed), np.float32)

        def vectors(rows: np.ndarray) -> np.ndarray:
            z = pull[rows]
            size = np.sqrt((z * z).sum(axis=1))
            keep = np.maximum(0, 1 - sparse / np.maximum(size, 1e-9))
            return -z * (keep / (np.sqrt(square[rows]) / alpha + l2))[:, None]

        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            for i in rng.permutation(len(bags)):
                rows, share = bags[i]
                if not len(rows):
                    continue
                e = vectors(rows)
                v = share @ e
                z = self.out @ v + self.bias
                p = np.exp(z - z.max())
                d = (p / p.sum()).astype(np.float32)
                d[y[i]] -= 1
                d *= np.float32(w[i])
                back = d @ self.out
                g2 = share * share * np.float32(back @ back)
                was = square[rows]
                square[rows] = was + g2
                pull[rows] += share[:, None] * back - ((np.sqrt(was + g2) - np.sqrt(was)) / np.float32(alpha))[:, None] * e
                self.out -= step / (1 + v @ v) * np.outer(d, v)
                self.bias -= step * d
        self.embed = vectors(np.arange(len(self.embed))) * np.float32(scale)
        self._slope = None
        return self

    def slopes(self) -> np.ndarray:
        """What one bucket adds to the log odds of label 1."""
        if self._slope is None:
            self._slope = self.embed @ (self.out[1] - self.out[0])
        return self._slope

    def score(self, text: str | None) -> float:
        """Probability of label 1; a NULL or wordless text has that of no words at all."""
        total, words, slope = 0.0, 0, self.slopes()
        text = text or ""
        at = 0
        while at < len(text):
            end = at + SLAB
            while end < len(text) and not (ord(text[end]) < 128 and _GAPS[ord(text[end])]) and end < at + 2 * SLAB:
                end += 1                                   # slabs end between words
            row, weight, n = subwords(text[at:end], len(self.embed))
            total += float(slope[row] @ weight) if n else 0.0
            words += n
            at = end
        z = float(self.bias[1] - self.bias[0]) + total / (words + BLANKS)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def labelled_draw(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text",
                  may_learn: Column | None = None, per_class: int = PER_CLASS,
                  most_chars: int = MOST_CHARS) -> tuple[list[str], list[int], list[float]]:
    """(texts, labels, weights) of about ``per_class`` documents of each label, by hashed id.

    Each label's ids are counted and those with a hash below the wanted share are taken, so
    no task ranks a label's rows; the weights give the labels their shares of all labelled
    ids. Texts over ``most_chars`` code points, NULL ids or texts, labels other than 0 and 1
    and ids labelled both ways teach nothing."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    rows = rows if may_learn is None else rows.where(may_learn)
    one = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    n = {r["_y"]: r["n"] for r in one.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}     # two rows
    if not n:
        return [], [], []
    share = F.lit(0.0)
    for y, k in n.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / k))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(13), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = one.where(unit < share).select("_id", "_y")                       # about 2 x per_class ids
    got = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x"))
           .where(F.col("_x").isNotNull() & (F.length("_x") <= most_chars))
           .join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_x").alias("_x")).collect())
    got = sorted((r["_id"], r["_x"], r["_y"]) for r in got)
    y = [r[2] for r in got]
    held = {v: y.count(v) for v in n}
    whole = sum(n.values())
    return [r[1] for r in got], y, [n[v] / whole * len(y) / held[v] for v in y]


def classify(docs: DataFrame, model: SubwordSoftmax, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``cut``) added; columns of these
    names are replaced. Every text is read whole, in slabs. NULL and wordless texts score what
    the bias alone says. Rows are judged alone: ties, repeats, NULL ids and an empty table do
    not matter."""
    bounded_batches(docs.sparkSession)
    # one float a bucket and the bias: a megabyte, whatever the corpus
    light = SubwordSoftmax(buckets=1, dim=1)
    light._slope, light.embed = model.slopes().astype(np.float32), np.empty((len(model.embed), 0), np.float32)
    light.bias = model.bias
    sent = docs.sparkSession.sparkContext.broadcast(light)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sent.value.score(t) for t in batch], dtype="float64")

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*rest, F.pandas_udf(judge, "double")(F.col(f"`{text}`")).alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model fitted outside the held-out quarter of ids, and every document's score.
    Without learnable rows all documents score one half."""
    part = split_number(F.col("doc_id"), 4)
    texts, y, w = labelled_draw(docs, labels, "toxic", may_learn=part != 2)
    model = SubwordSoftmax()
    if texts:
        model.fit(texts, y, w)
    held = docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    return classify(held, model).select("doc_id", "held_out", "score", "predicted")
