"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (SentencePiece)
the text, before which it puts a space itself; both cut the same bytes. Merging the
ascending ends of A's and B's tokens visits every pair of tokens that share a byte: at
place (i, j) of the merge token i of A meets token j of B, and the one that ends first is
left behind. A group closes where an end of A equals an end of B.

The merge of ``n_a + n_b`` ends is cut into pieces of the same number of steps. Where a
piece starts is found by a binary search along its diagonal of the (i, j) grid, without
the pieces before it. All pieces of many documents run side by side, one numpy step for
all of them; each emits its overlaps and the groups it closes, and a running sum over the
pieces numbers the groups that cross their borders.

Both tokenizers cut before a single space that a non-space follows (A's pattern and B's
pieces never cross it), so a text's ids are those of its parts one after the other and
each distinct part is encoded once while it is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HeldIds, bounded_batches, saved

PIECE = 64                      # merge steps of a piece
SLICE_CHARS = 1 << 20           # characters of text that are merged side by side
MOST_PARTS = 300_000            # distinct parts held by a task
COMMON_PAIRS = 1_000_000        # rows of the id-pair table that are broadcast, the most frequent ones
_CUT = re.compile(r"(?<! )(?= \S)")
_ROUGH = re.compile(r" (?:\s|$)")


def merge_path(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """The merge of two ascending arrays of ends whose last elements are equal.

    Returns (a, b, a_group, b_group): the overlapping pairs (places in the two arrays, in
    merge order) and the group number of every token of A and of B."""
    na, nb = len(a_ends), len(b_ends)
    total = na + nb
    top = np.iinfo(np.int64).max
    a, b = np.append(a_ends, top), np.append(b_ends, -1)
    a_start, b_start = np.concatenate([[0], a_ends]), np.concatenate([[0], b_ends])
    diagonal = np.arange(0, total, piece)
    lo, hi = np.maximum(diagonal - nb, 0), np.minimum(diagonal, na)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) >> 1
        below = a[mid] <= b[diagonal[open_] - 1 - mid]          # A goes first where ends are equal
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    i, j = lo, diagonal - lo
    shape = (piece, len(diagonal))
    at_i, at_j = np.empty(shape, np.int64), np.empty(shape, np.int64)
    takes, links, closes = np.empty(shape, bool), np.empty(shape, bool), np.empty(shape, bool)
    for t in range(piece):
        at_i[t], at_j[t] = i, j
        ae, be, start = a[i], b[j], a_start[i]
        take = ae <= be
        takes[t] = take
        links[t] = (start < be) & (b_start[j] < ae)
        closes[t] = ~take & (start == be)
        i = np.minimum(i + take, na)
        j = np.minimum(j + ~take, nb)
    flat = lambda x: x.T.reshape(-1)[:total]
    takes, links, closed = flat(takes), flat(links), flat(closes)
    # groups closed inside a piece so far, plus those of the pieces before it
    rows = np.zeros(len(diagonal) * piece, np.int64)
    rows[:total] = closed
    rows = rows.reshape(-1, piece)
    inside = np.cumsum(rows, axis=1) - rows
    before = np.cumsum(rows.sum(axis=1)) - rows.sum(axis=1)
    group = (inside + before[:, None]).reshape(-1)[:total]
    return flat(at_i)[links], flat(at_j)[links], group[takes], group[~takes]


class Aligner:
    """Encodes texts with both tokenizers and merges their ends."""

    def __init__(self, a_file: str, b_file: str, most_parts: int = MOST_PARTS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, decoders
        self._a = Tokenizer.from_file(a_file)
        self._a.encode_special_tokens = True            # their strings in a text are plain text
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        if not isinstance(self._a.decoder, decoders.ByteLevel):
            raise ValueError("tokenizer A is not byte-level")
        n = self._a.get_vocab_size(with_added_tokens=True)
        as_byte = self._byte_of_char()
        entries = [self._a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(as_byte[c] for c in e) if all(c in as_byte for c in e) else e.encode() for e in entries]
        self.b_bytes = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        ids = max(len(self.a_size), len(self.b_size))
        text = [str(i).encode() for i in range(ids)]
        self._digits_n = np.array([len(t) for t in text])
        width = int(self._digits_n.max())
        self._digits = np.frombuffer(b"".join(t.ljust(width, b" ") for t in text), np.uint8).reshape(ids, width)
        self._most = most_parts
        self._forget()

    @staticmethod
    def _byte_of_char() -> dict[str, int]:
        """Byte-level vocabularies write a printable Latin-1 byte as itself and the other
        bytes, in order, as the characters from 256 on."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self._held_a, self._held_b = HeldIds(), HeldIds()       # the same rows in both
        self._same = np.zeros(1 << 12, bool)                    # whether both give the part's own bytes

    def _both(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For each tokenizer the ids of the parts one after the other and how many each has,
        from one text of them all; None if that text's bytes are not kept or a token crosses
        from one part into the next."""
        whole = " ".join(parts)
        raw = (" " + whole).encode("utf-8", "replace")
        ends = np.cumsum([len(p) + 1 for p in parts] if len(raw) == len(whole) + 1
                         else [len(p.encode("utf-8", "replace")) + 1 for p in parts])
        out = []
        for ids, entries, size in (
                (self._a.encode_batch_fast([" " + whole], add_special_tokens=False)[0].ids, self.a_bytes, self.a_size),
                (self._b.encode(whole, num_threads=1), self.b_bytes, self.b_size)):
            if b"".join(map(entries.__getitem__, ids)) != raw:
                return None
            flat = np.array(ids, np.int32)
            upto = np.cumsum(size[flat])
            last = np.searchsorted(upto, ends)
            if (upto[last] != ends).any():
                return None
            out.append((flat, np.diff(last, prepend=-1)))
        return out

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts, held without their first space: those that begin and end in
        something visible many at a time, the others by themselves."""
        plain = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        groups = [plain[lo:lo + 4096] for lo in range(0, len(plain), 4096)]
        known = set(plain)
        groups += [[p] for p in parts if p not in known]
        while groups:
            some = groups.pop()
            both = self._both(some)
            if both is None and len(some) > 1:
                half = len(some) // 2
                groups += [some[:half], some[half:]]
                continue
            same = both is not None
            none = (np.empty(0, np.int32), np.zeros(len(some), np.int64))
            (a, an), (b, bn) = both or (none, none)
            rows = self._held_a.add(some, a, an)
            self._held_b.add(some, b, bn)
            self._same = HeldIds._room(self._same, len(self._held_a))
            self._same[rows] = same

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(a ids, a ids of each text, b ids, b ids of each text) one text after the other;
        none for NULL and empty texts and for those whose bytes one tokenizer changes."""
        if len(self._held_a) > self._most:
            self._forget()
        parts, n = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if not t:
                continue
            if t[0] == " " or _ROUGH.search(t):
                some = [p[1:] for p in _CUT.split(" " + t) if p]
            else:
                some = t.split(" ")
            parts += some
            n[k] = len(some)
        rows = self._held_a.rows(parts, self._learn)
        owner = np.repeat(np.arange(len(texts)), n)
        good = np.bincount(owner[~self._same[rows]], minlength=len(texts)) == 0
        keep = good[owner]
        rows, owner = rows[keep], owner[keep]
        a, an = self._held_a.gather(rows)
        b, bn = self._held_b.gather(rows)
        count = lambda x: np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64)
        return a, count(an), b, count(bn)

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Tokens, links and groups of all texts one after the other, and how many each text has."""
        a, an, b, bn = self.tokens(texts)
        if not len(a):
            none = np.empty(0, np.int64)
            return {"a": a, "an": an, "b": b, "bn": bn, "la": none, "lb": none, "ln": an * 0,
                    "ga": none, "gb": none, "gn": an * 0}
        la, lb, ga, gb = merge_path(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        owner = np.repeat(np.arange(len(texts)), an)
        closes = np.flatnonzero(np.diff(ga, append=ga[-1] + 1))
        per = lambda x: np.bincount(x, minlength=len(texts)).astype(np.int64)
        return {"a": a, "an": an, "b": b, "bn": bn, "la": la, "lb": lb, "ln": per(owner[la]),
                "ga": ga, "gb": gb, "gn": per(owner[closes])}

    def group_texts(self, m: dict[str, np.ndarray]) -> list[memoryview]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3`` in ASCII."""
        a, b, ga, gb = m["a"], m["b"], m["ga"], m["gb"]
        n = len(a) + len(b)
        if not n:
            return [memoryview(b"")] * len(m["an"])
        groups = int(ga[-1]) + 1
        a_upto = np.cumsum(np.bincount(ga, minlength=groups))
        b_upto = np.cumsum(np.bincount(gb, minlength=groups))
        at_a = np.arange(len(a)) + np.concatenate([[0], b_upto])[ga]
        at_b = np.arange(len(b)) + a_upto[gb]
        ids, mark = np.empty(n, np.int32), np.empty(n, np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a] = np.where(np.diff(ga, append=-1) != 0, ord("|"), ord(","))
        mark[at_b] = np.where(np.diff(gb, append=-1) != 0, ord(";"), ord(","))
        width = self._digits.shape[1]
        chars = np.empty((n, width + 1), np.uint8)
        chars[:, :width] = self._digits[ids]
        chars[:, width] = mark
        sizes = self._digits_n[ids]
        shown = np.arange(width + 1)[None, :] < sizes[:, None]
        shown[:, width] = True
        flat = memoryview(chars[shown].tobytes())
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])[np.concatenate([[0], np.cumsum(m["an"] + m["bn"])])].tolist()
        return [flat[lo:max(lo, hi - 1)] for lo, hi in zip(ends, ends[1:], strict=False)]

    def pairs(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(a id, b id, links, pairs of each text): each text's distinct linked id pairs."""
        na, nb = len(self.a_size), len(self.b_size)
        owner = np.repeat(np.arange(len(m["ln"]), dtype=np.int64), m["ln"])
        key, n = np.unique((owner * na + m["a"][m["la"]]) * nb + m["b"][m["lb"]], return_counts=True)
        rest, b = np.divmod(key, nb)
        owner, a = np.divmod(rest, na)
        return a, b, n, np.bincount(owner, minlength=len(m["ln"]))


def _slices(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                    pa.array(values.astype(np.int32)))


def _mapped(docs: DataFrame, text: str, a_file: str, b_file: str, schema: str, make) -> DataFrame:
    """``docs`` with the columns of ``schema`` that ``make(aligner, merged)`` gives for a
    slice of texts; columns of these names are replaced. Stores live as long as the task."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(a_file, b_file)
            texts = batch.column(0).to_pylist()
            for lo, hi in _slices(texts, SLICE_CHARS):
                made = make(aligner, aligner.align(texts[lo:hi]))
                kept = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], *made], names=[*kept.schema.names[1:], *names])

    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    sent = docs.select(F.col(f"`{text}`").alias("_text_in"), *rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[1:])
    return sent.mapInArrow(run, f"{fields}, {schema}" if fields else schema)


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of every whole text: a_ids and b_ids; a_group and b_group,
    the number (from 0) of each token's group; link_a and link_b, the places of each pair of
    overlapping tokens.

    * NULL and empty texts, and texts whose bytes a tokenizer changes (such as a literal
      U+2581), have empty arrays.
    * Rows are aligned alone: NULL ids, ties and repeated rows do not matter; an empty table
      stays empty. Memory follows the longest text, not the table.
    """
    def make(aligner: Aligner, m: dict) -> list:
        # places and groups count from the start of each text
        base = lambda n: np.cumsum(n) - n
        less = lambda x, start, n: _lists(x - np.repeat(start, n), n)
        an, bn, ln = m["an"], m["bn"], m["ln"]
        return [_lists(m["a"], an), _lists(m["b"], bn), less(m["ga"], base(m["gn"]), an),
                less(m["gb"], base(m["gn"]), bn), less(m["la"], base(an), ln), less(m["lb"], base(bn), ln)]
    names = ("a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b")
    return _mapped(docs, text, a_file, b_file, ", ".join(f"{n} array<int>" for n in names), make)


def aligned_pairs(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, groups_sha256 ('' without
    tokens) and the distinct linked id pairs: pair_a, pair_b and pair_n, their links here."""
    def make(aligner: Aligner, m: dict) -> list:
        a, b, n, per = aligner.pairs(m)
        digest = [sha256(g).hexdigest() if len(g) else "" for g in aligner.group_texts(m)]
        return [*(pa.array(m[k], pa.int64()) for k in ("an", "bn", "gn", "ln")), pa.array(digest, pa.string()),
                _lists(a, per), _lists(b, per), _lists(n, per)]
    return _mapped(docs, text, a_file, b_file, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                   "groups_sha256 string, pair_a array<int>, pair_b array<int>, pair_n array<int>", make)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links of the corpus hold an id pair, and whether no other
    pair of that b id has more. Pairs are summed before the shuffle."""
    each = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    total = each.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(
        F.sum(F.col("p.pair_n").cast("long")).alias("links"))
    total = saved(total, "pair_counts")
    top = total.groupBy("b").agg(F.max("links").alias("most"))
    return total.join(top, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text: str = "text",
                     common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The aligned rows are written once; the corpus counts are looked up by their pairs. The
    ``common_pairs`` most frequent pairs are broadcast (that many rows at most); the others,
    none of which is hot, are joined by a shuffle."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = saved(aligned_pairs(d, a_file, b_file).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = saved(pair_counts(rows), "pair_best")
    each = rows.select("_row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select(
        "_row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").cast("long").alias("n"))

    def summed(x: DataFrame) -> DataFrame:
        return x.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
                                     F.sum(F.col("n") * F.col("links")).alias("count_sum"))

    if counts.limit(common_pairs + 1).count() <= common_pairs:
        found = summed(each.join(F.broadcast(counts), ["a", "b"]))
    else:
        common = saved(counts.orderBy(F.desc("links"), "a", "b").limit(common_pairs), "common_pairs")
        rare = counts.join(F.broadcast(common.select("a", "b")), ["a", "b"], "left_anti")
        hit = summed(each.join(F.broadcast(common), ["a", "b"]))
        miss = summed(each.join(F.broadcast(common.select("a", "b")), ["a", "b"], "left_anti").join(rare, ["a", "b"]))
        found = hit.union(miss).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (rows.drop("pair_a", "pair_b", "pair_n").join(found, "_row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
