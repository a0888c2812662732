"""Language identification by rank-order profiles.

A profile is a language's ``top`` most frequent letter n-grams (n from 1 to 3, words
padded with a boundary) in rank order. A document's own most frequent n-grams are ranked
the same way; the distance to a language is the sum, over the document's n-grams, of how
far each is out of place in the profile (``top`` places when it is not there at all).
The nearest language wins; among equals the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, releasing

TOP = 300
PER_LANGUAGE = 1000     # documents that a profile is learned from, at most
UNKNOWN = "und"
EDGE = 1                # stands for a word's boundary; no letter has this code point
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text (21 bits a letter, ascending) and their counts."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    c = np.concatenate([[EDGE], np.where(_letters()[c], c, EDGE), [EDGE]])
    c = c[np.concatenate([[True], (c[1:] != EDGE) | (c[:-1] != EDGE)])]     # one boundary between words
    if len(c) < 3:
        return none, none
    two = c[:-1] | c[1:] << 21
    three = (two[:-1] | c[2:] << 42)[c[1:-1] != EDGE]
    g = np.sort(np.concatenate([c[c != EDGE], two, three]))
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.diff(np.append(first, len(g)))


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, equals by value."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                   may_learn: Column | None = None, top: int = TOP, per_language: int = PER_LANGUAGE,
                   most_sent: int = 1_000_000) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams.

    A profile counts the whole texts of ``per_language`` labelled documents, those with
    the smallest hashed ids: a bounded sample, so the profiles (``top`` numbers for each
    language) are all that the driver holds. ``may_learn`` restricts the rows; rows with
    a NULL id, text or language teach nothing."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if may_learn is None else rows.where(may_learn)
    narrow = rows.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = narrow.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).select("_id").distinct()
    if chosen.limit(most_sent + 1).count() <= most_sent:
        chosen = F.broadcast(chosen)
    sample = rows.select(F.col(id_col).alias("_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(chosen, "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(ngrams(t))
            for name, parts in by.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(g), "gram": g, "n": n})

    sums = (sample.select("lang", "text").mapInArrow(releasing(count), "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("lang", "gram", "r").collect()
    out: dict[str, list] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Profiles:
    """All profiles side by side: the n-grams that any of them holds, and their places in each."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.places = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the distance as a share of the largest possible."""
        own = ranked(*ngrams(text), self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        places = self.places[np.where(known, at, len(self.grams))]
        off = np.where(places >= 0, np.minimum(np.abs(places - np.arange(len(own))[:, None]), self.top), self.top)
        total = off.sum(axis=0)
        j = int(total.argmin())
        return self.names[j], 1.0 - float(total[j]) / (self.top * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", top: int = TOP,
             pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the two columns added; columns of these names are replaced.

    * NULL text, or a text with no letter: ``und``, score 0. So is everything when there
      are no profiles. Whole texts are read, whatever their length.
    * Ties, repeated rows and NULLs in other columns do not matter: each row is judged alone.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, top))   # top x languages numbers

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([sent.value.predict(t) for t in batch], columns=["pred", "score"])

    judged = F.pandas_udf(judge, "pred string, score double")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    both = docs.select(*rest, judged(F.col(f"`{text}`")).alias("_judged"))
    return both.select(*rest, F.col("_judged.pred").alias(pred), F.col("_judged.score").alias(score))


def split_number(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def language_digest(docs: DataFrame) -> DataFrame:
    """Profiles from the documents outside the held-out third, and a prediction for every one."""
    part = split_number(F.col("doc_id"), 3)
    profiles = learn_profiles(docs, may_learn=part != 1)
    held = docs.select("doc_id", "text", F.coalesce(part == 1, F.lit(False)).alias("held_out"))
    return identify(held, profiles).select("doc_id", "held_out", "lang_pred", "score")
