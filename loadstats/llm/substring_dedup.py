"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window is ``words`` consecutive words of one document. Each word that lies in a window
whose word sequence also starts in a document with a smaller id is removed.

Token k-mers are the graph's edges. Only minimizers are kept: of the k-mers in a window
the one with the smallest hash, so equal windows keep the same k-mer at the same place.
For every kept k-mer the documents are counted, and what precedes and follows it: the
text from the kept k-mer before, and the text to the next one.

* A k-mer of one document alone ends there: no window that it stands for is repeated.
* Where all occurrences of a k-mer go on to the same next one, and all of that one's come
  from it, the path does not branch. Joining these facts back to the occurrences compacts
  each nonbranching path into one row a document, whatever its length: all windows inside
  its text are in the same documents.
* The windows that are left, around branches and path ends, are rows of their own.

Rows (paths and single windows) are grouped by their hash and by a second, independent
hash of the words at their source coordinates, which verifies the span; the smallest id
of a group is the document that keeps its copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forgettable, mixed, releasing, saved, sendable, word_hasher

WORDS = 50
K = 16
_PLACE = np.uint64((1 << 20) - 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two independent hashes of each word, one a column."""
    return word_hasher().both(words)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` consecutive numbers: running minima from both ends of blocks of ``w``."""
    n = len(x)
    full = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


class Rolling:
    """Hashes of spans of words from running sums of ``h[i] * r**i`` (modulo 2**64)."""

    def __init__(self, r: int, salt: int):
        self._r, self._salt = r, np.uint64(salt)
        self.forget()

    def forget(self) -> None:
        self._up, self._down = np.ones(1, np.uint64), np.ones(1, np.uint64)     # powers of r and of its inverse

    def _grown(self, n: int) -> None:
        while len(self._up) < n + 1:
            k = len(self._up)
            self._up = np.concatenate([self._up, self._up * np.uint64(pow(self._r, k, 1 << 64))])
            self._down = np.concatenate([self._down, self._down * np.uint64(pow(self._r, -k, 1 << 64))])

    def sums(self, h: np.ndarray) -> np.ndarray:
        self._grown(len(h))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ self._salt) * self._up[:len(h)])])

    def spans(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``lo`` to before ``hi``, the same wherever they stand."""
        self._grown(len(sums))
        body = (sums[hi] - sums[lo]) * self._down[lo]
        return mixed(body ^ ((hi - lo).astype(np.uint64) << np.uint64(40)))

    def every(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of every ``k`` consecutive words."""
        self._grown(len(sums))
        n = len(sums) - k
        return mixed((sums[k:] - sums[:n]) * self._down[:n])


class PrimeRolling:
    """Hashes of spans of words from running sums modulo the prime 2**31 - 1, two of them side
    by side with bases of their own. Nothing of :class:`Rolling` enters: the words' hashes are
    others, and sums modulo a prime do not fail where sums modulo a power of two do (on words
    that alternate like the Thue-Morse sequence)."""
    P = (1 << 31) - 1

    def __init__(self, bases: tuple[int, int]):
        self._bases = bases
        self.forget()

    def forget(self) -> None:
        self._up = [np.ones(1, np.uint64) for _ in self._bases]
        self._down = [np.ones(1, np.uint64) for _ in self._bases]

    def _grown(self, n: int) -> None:
        p = np.uint64(self.P)
        while len(self._up[0]) < n + 1:
            k = len(self._up[0])
            for held, sign in ((self._up, 1), (self._down, -1)):
                for x, base in enumerate(self._bases):
                    held[x] = np.concatenate([held[x], held[x] * np.uint64(pow(base, sign * k, self.P)) % p])

    def sums(self, h: np.ndarray) -> np.ndarray:
        """Two rows of running sums; each takes half of the words' hashes. A sum of 2**32
        terms below the prime fits its 64 bits."""
        self._grown(len(h))
        p, out = np.uint64(self.P), np.zeros((2, len(h) + 1), np.uint64)
        for x, part in enumerate((h >> np.uint64(32), h & np.uint64(0xFFFFFFFF))):
            out[x, 1:] = np.cumsum((part % p + np.uint64(1)) % p * self._up[x][:len(h)] % p) % p
        return out

    def spans(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        self._grown(sums.shape[1])
        p = np.uint64(self.P)
        one, two = ((sums[x, hi] + p - sums[x, lo]) % p * self._down[x][lo] % p for x in (0, 1))
        return mixed((one << np.uint64(31) | two) ^ ((hi - lo).astype(np.uint64) << np.uint64(40)))


_ROLLING = forgettable(Rolling(0x9E3779B97F4A7C15, 0))
_PROOF = forgettable(PrimeRolling((1_111_111_121, 1_828_174_637)))


def anchors(sums: np.ndarray, words: int = WORDS, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a document's running sums: the kept k-mers' places (ascending) and hashes, and for
    every window the index of the kept k-mer that stands for it."""
    kmers = _ROLLING.every(sums, k)
    key = (kmers & ~_PLACE) | (np.arange(len(kmers), dtype=np.uint64) & _PLACE)    # the leftmost of equals
    low = (_least(key, words - k + 1) & _PLACE).astype(np.int64)
    start = np.arange(len(low))
    place = start + ((low - start) & int(_PLACE))                                   # places wrap at 2**20
    # windows move on, and so do the places that stand for them
    new = np.concatenate([[True], place[1:] != place[:-1]])
    at = place[new]
    return at, kmers[at], np.cumsum(new) - 1


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []      # bytes: splits at 9-13 and 32


def _edges(words: int, k: int):
    """Each document's kept k-mers: token, id, and hashes of the text from the one before and
    to the next; 0 where there is none or the document has several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = _split(t)
                if len(w) < words:
                    continue
                sums = _ROLLING.sums(_hashes(w)[:, 0])
                at, token, _ = anchors(sums, words, k)
                link = _ROLLING.spans(sums, at[:-1], at[1:] + k)
                ins, outs = np.concatenate([[np.uint64(0)], link]), np.concatenate([link, [np.uint64(0)]])
                order = np.argsort(token, kind="stable")
                token, ins, outs = token[order], ins[order], outs[order]
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                for x, e in ((2, ins), (3, outs)):
                    lo, hi = np.minimum.reduceat(e, first), np.maximum.reduceat(e, first)
                    out[x].append(np.where(lo == hi, lo, 0))
                out[0].append(token[first])
                out[1].append(np.full(len(first), i, dtype=np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.uint64).view(np.int64) if j != 1 else np.concatenate(c))
                                                  for j, c in enumerate(out)], names=["token", "id", "e_in", "e_out"])
    return run


def _paths(words: int, k: int):
    """Rows (key, proof, id, start, windows): nonbranching paths, and single windows beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [], [])
            known, flags = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, t, tokens, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), known, flags, strict=True):
                w = _split(t)
                if len(w) < words:
                    continue
                h = _hashes(w)
                sums = _ROLLING.sums(h[:, 0])
                at, token, which = anchors(sums, words, k)
                tokens = np.array(tokens, dtype=np.int64).view(np.uint64)
                order = np.argsort(tokens)
                tokens, marks = tokens[order], np.array(marks, dtype=np.int64)[order]
                near = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                repeated = tokens[near] == token
                mark = np.where(repeated, marks[near], 0)
                onward = repeated[:-1] & repeated[1:] & (mark[:-1] & 2 > 0) & (mark[1:] & 1 > 0)
                head = np.concatenate([[True], ~onward])
                chain = np.cumsum(head) - 1                               # path of each kept k-mer
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(at)) - 1
                lo, hi = at[first], at[last] + k                          # text of each path
                start = np.arange(len(which))
                own = chain[which]
                inside = repeated[which] & (start >= lo[own]) & (start + words <= hi[own])
                single = repeated[which] & ~inside
                whole = np.flatnonzero(repeated[first] & (hi - lo >= words))
                one = np.flatnonzero(single)
                starts = np.concatenate([lo[whole], one])
                n = np.concatenate([hi[whole] - lo[whole] - words + 1, np.ones(len(one), dtype=np.int64)])
                ends = starts + n + words - 1
                out[0].append(_ROLLING.spans(sums, starts, ends))
                out[1].append(_PROOF.spans(_PROOF.sums(h[:, 1]), starts, ends))
                out[2].append(np.full(len(n), i, dtype=np.int64))
                out[3].append(starts)
                out[4].append(n)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).view(np.int64) if j < 2 else np.concatenate(c)) for j, c in enumerate(out)],
                    names=["key", "proof", "id", "start", "windows"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """(id, start, windows, source_id, source_start): for each span that a smaller id also has,
    its first word, the number of windows that start in it one after another, and where the
    smallest such id has it. Saved as a table.

    * NULL ids are not compared; NULL, empty and short texts have no window.
    * Rows that repeat an id are one document: they never remove from one another.
    * Integer ids. Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    edges = saved(d.mapInArrow(releasing(_edges(words, k)), "token long, id long, e_in long, e_out long"), "edges")
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    nodes = (edges.groupBy("token").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"),
                                        (one("e_in").cast("int") + 2 * one("e_out").cast("int")).alias("mark"))
             .where("_lo != _hi").select("token", "mark"))
    found = (edges.select("token", "id").join(nodes, "token").groupBy("id")
             .agg(F.collect_list("token").alias("tokens"), F.collect_list("mark").alias("marks")))   # one document's own
    found = saved(found, "tokens")
    some = d.join(sendable(found.select("id")), "id", "left_semi")
    rows = saved(some.join(found, "id").select("id", "text", "tokens", "marks")
                 .mapInArrow(releasing(_paths(words, k)), "key long, proof long, id long, start long, windows long"), "paths")
    source = (rows.groupBy("key", "proof").agg(F.min(F.struct("id", "start")).alias("_s"), F.max("id").alias("_hi"))
              .where("_s.id != _hi").select("key", "proof", F.col("_s.id").alias("source_id"), F.col("_s.start").alias("source_start")))
    return saved(rows.join(source, ["key", "proof"]).where("id > source_id")
                 .select("id", "start", "windows", "source_id", "source_start"), "spans")


def _remover(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = ([], [], [], [])
            for t, starts, n in zip(*(b.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                w = _split(t)
                if starts:
                    step = np.zeros(len(w) + 1, dtype=np.int64)
                    at, to = np.array(starts), np.array(starts) + np.array(n) + words - 1
                    np.add.at(step, at, 1)
                    np.add.at(step, to, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                    lost = int(gone.sum())
                else:
                    kept, lost = b" ".join(w), 0
                cols[0].append(len(w))
                cols[1].append(lost)
                cols[2].append(hashlib.sha256(kept).hexdigest())
                cols[3].append(kept.decode("utf-8") if starts else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text",
                 words: int = WORDS) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept_sha256, kept) of every row of ``docs``.

    ``kept`` is the text that is left, words joined by one space, where something was
    removed, else NULL. Only the texts that lose something are joined with their spans."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    cut = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))
    cut = saved(cut, "cuts")
    ids = sendable(cut.select("id"))
    none = F.array().cast("array<long>")
    whole = d.join(ids, "id", "left_anti").select("id", "text", none.alias("starts"), none.alias("windows"))
    less = d.join(ids, "id", "left_semi").join(cut, "id").select("id", "text", "starts", "windows")
    schema = f"id {dict(d.dtypes)['id']}, n_words long, n_removed long, kept_sha256 string, kept string"
    made = whole.mapInArrow(releasing(_remover(words)), schema).union(less.mapInArrow(releasing(_remover(words)), schema))
    return made.withColumnRenamed("id", id_col)


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text",
                  words: int = WORDS) -> DataFrame:
    """``docs`` with what :func:`repeated_spans` found cut out: a text that loses words is what
    is left of it, joined by one space; every other text stays as it is, to the byte."""
    cut = saved(spans.groupBy("id").agg(F.collect_list("start").alias("_starts"),
                                        F.collect_list("windows").alias("_windows"))
                .withColumnRenamed("id", "_cut_id"), "cuts")
    ids = sendable(cut.select("_cut_id"))
    same = F.col(id_col) == F.col("_cut_id")
    held = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.join(ids, same, "left_anti")
    less = docs.join(ids, same, "left_semi").select(F.struct(*held).alias("_row"), F.col(id_col).alias("_own")).join(
        cut, F.col("_own") == F.col("_cut_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remove = _remover(words)
        for b in batches:
            made = next(remove(iter([pa.RecordBatch.from_arrays(b.columns[1:], names=["id", "text", "starts", "windows"])])))
            yield pa.RecordBatch.from_arrays([b.column(0), made.column(4)], names=["_row", "_kept"])

    sent = less.select("_row", "_own", F.col("_row").getField(text).alias("_text"), "_starts", "_windows")
    schema = sent.select("_row").schema.add("_kept", "string")
    made = sent.mapInArrow(releasing(run), schema)
    return whole.union(made.select(*[F.col("_kept").alias(c) if c == text else F.col("_row").getField(c).alias(c)
                                     for c in docs.columns]))
