"""Token ids as wavelet matrices: one compressed file for each shard.

Documents are range-partitioned by id. Each partition is a shard: its texts are encoded,
every document's ids are followed by the end id, and the ids become one wavelet matrix.

File format (little-endian)::

    magic b"WVM1" | u32 header length | header (JSON, UTF-8) | blocks

The header holds ``n`` (ids), ``bits`` (planes, most significant bit first), ``zeros``
(unset bits of each plane), ``docs`` (number of documents), and for every plane the byte
lengths and the set bits of its blocks. A plane is its bits packed eight to a byte, cut
into blocks of ``BLOCK`` bytes, each compressed by itself with zstd; rank is the running
sum of set bits over the blocks before plus a count in one block, so reading one token
unpacks one block of each plane. After the planes come the documents' ids and lengths,
in document order, as one zstd block of two int64 arrays and a bit a document: whether it
has an id.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import HeldIds, bounded_batches, releasing, running_offsets, saved

MAGIC = b"WVM1"
BLOCK = 1 << 13
RUN = 1 << 15
SHARD_BYTES = 24 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _runs(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int, int]]:
    """A plane in runs short enough for the cache: each run's slice, where in it unset and set bits
    are, and where in the next plane's order the first of either goes."""
    lo, hi = 0, zeros
    for i in range(0, len(one), RUN):
        part = slice(i, i + RUN)
        low, high = np.flatnonzero(~one[part]), np.flatnonzero(one[part])
        yield part, low, high, lo, hi
        lo, hi = lo + len(low), hi + len(high)


class WaveletMatrix:
    """Token access, counting and occurrence lookup in one file's bytes."""

    def __init__(self, blob: bytes):
        import zstandard
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size, = struct.unpack_from("<I", blob, 4)
        head = json.loads(blob[8:8 + size])
        self.n, self.bits, self.zeros, self.docs = head["n"], head["bits"], head["zeros"], head["docs"]
        self._blob, self._zstd, self._held = blob, zstandard.ZstdDecompressor(), {}
        at = 8 + size
        self._at, self._before = [], []
        for lengths, ones in zip(head["lengths"], head["ones"], strict=True):
            self._at.append(at + np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
            self._before.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))
            at = int(self._at[-1][-1])
        self._tail = at

    @staticmethod
    def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray, known: np.ndarray | None = None) -> bytes:
        """``known`` says which documents have an id (all by default)."""
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1).compress
        ids = np.ascontiguousarray(ids, dtype=np.uint32)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        if bits <= 16:
            ids = ids.astype(np.uint16)
        zeros, lengths, ones, blocks = [], [], [], []
        after = np.empty_like(ids)
        for b in range(bits - 1, -1, -1):
            one = (ids & (1 << b)) != 0
            packed = np.packbits(one)
            cut = [packed[i:i + BLOCK] for i in range(0, len(packed), BLOCK)]
            ones.append([int(_ONES[c].sum()) for c in cut])
            made = [squeeze(c.tobytes()) for c in cut]
            lengths.append([len(c) for c in made])
            blocks += made
            zeros.append(len(ids) - sum(ones[-1]))
            for part, low, high, lo, hi in _runs(one, zeros[-1]):
                ids[part].take(low, out=after[lo:lo + len(low)], mode="clip")
                ids[part].take(high, out=after[hi:hi + len(high)], mode="clip")
            ids, after = after, np.empty_like(ids) if b == bits - 1 else ids     # the caller's array stays
        head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "docs": len(doc_ids),
                           "lengths": lengths, "ones": ones}).encode()
        known = np.ones(len(doc_ids), bool) if known is None else known
        tail = squeeze(np.concatenate([doc_ids, doc_lengths]).astype("<i8").tobytes() + np.packbits(known).tobytes())
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blocks, tail])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, lengths and whether there is an id, of the documents in order."""
        raw = self._zstd.decompress(self._blob[self._tail:])
        both = np.frombuffer(raw, dtype="<i8", count=2 * self.docs)
        known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * self.docs), count=self.docs).astype(bool)
        return both[:self.docs], both[self.docs:], known

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._held:
            if len(self._held) > 256:
                self._held.clear()
            at = self._at[plane]
            raw = self._zstd.decompress(self._blob[at[k]:at[k + 1]])
            self._held[plane, k] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))
        return self._held[plane, k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // (8 * BLOCK))[i % (8 * BLOCK)])

    def _rank1(self, plane: int, i: int) -> int:
        """Set bits of a plane before place ``i``."""
        k, rest = divmod(i, 8 * BLOCK)
        return int(self._before[plane][k]) + (int(self._block(plane, k)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value."""
        ones = self._before[plane]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * 8 * BLOCK, self.n) - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        inside = np.flatnonzero(self._block(plane, block) == bit)
        return block * 8 * BLOCK + int(inside[k - int(counts[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            token = token << 1 | bit
            r = self._rank1(p, i)
            i = self.zeros[p] + r if bit else i - r
        return token

    def _span(self, token: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token before place ``upto`` (all by default): its rank."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._span(token, self.n if upto is None else upto)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of a token: its select."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._span(token, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        ids = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        out = np.empty_like(ids)
        for p in range(self.bits - 1, -1, -1):
            at = self._at[p]
            raw = b"".join(self._zstd.decompress(self._blob[at[k]:at[k + 1]]) for k in range(len(at) - 1))
            one = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).view(bool)
            for part, low, high, lo, hi in _runs(one, self.zeros[p]):
                to = out[part]
                to[low] = ids[lo:lo + len(low)]
                to[high] = ids[hi:hi + len(high)] | (1 << (self.bits - 1 - p))
            ids, out = out, ids
        return ids.astype(np.uint32)


_ID = attrgetter("id")
_GAP = re.compile(r"(?= \S)")
_MIXED = re.compile(r" (?:\s|$)")


def _byte_chars() -> dict[int, int]:
    """Of each byte, the character that stands for it in a byte-level vocabulary: itself where it
    can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Encoder:
    """Encodes whole texts as the tokenizer file defines it, each distinct word once a call.

    The vocabulary's pattern never puts a token across a place before a space that a
    non-space follows, so a text's ids are the ids of its pieces one after the other. Arrow
    numbers the distinct words of all texts of a call; they are made of the pattern's matches,
    which are encoded once each while held. A text that holds one of the file's added tokens
    (such as an end marker) is encoded by the library as a whole."""

    def __init__(self, tokenizer_file: str, most_held: int = 400_000, most_chars: int = 12 << 20):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, models, pre_tokenizers
        self._t = Tokenizer.from_file(tokenizer_file)
        # a file of byte-level merges alone: its pattern's matches can go straight to its model
        direct = (self._t.normalizer is None and isinstance(self._t.pre_tokenizer, pre_tokenizers.ByteLevel)
                  and isinstance(self._t.model, models.BPE))
        self._merged = self._t.model.tokenize if direct else None
        self._chars_of = _byte_chars()
        added = [a.content for a in self._t.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._matches = regex.compile(PATTERN).findall
        self._line, = self._t.encode("\n", add_special_tokens=False).ids
        self._most, self._most_chars = most_held, most_chars
        self._forget()

    def _forget(self) -> None:
        self._tokens = HeldIds()        # of a match of the pattern
        self._chars = 0                 # of what it holds

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _encode(self, matches: list[str]) -> None:
        """Matches that are not white space go to the library's model as the characters of their
        bytes; without such a model to the library, many at a time, a line each."""
        self._chars += sum(map(len, matches))
        lines = [m for m in matches if not m.isspace()]
        for i in range(0, len(lines), 4096):
            some = lines[i:i + 4096]
            if self._merged is not None:
                spelled = "\n".join(some).encode().decode("latin-1").translate(self._chars_of).split(chr(self._chars_of[10]))
                made = list(map(self._merged, spelled))
                sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
                ids = np.fromiter(map(_ID, chain.from_iterable(made)), dtype=np.int32, count=int(sizes.sum()))
                self._tokens.add(some, ids, sizes)
                continue
            ids = self._plain("\n".join(some))
            end = np.flatnonzero(np.append(ids, self._line) == self._line)
            self._tokens.add(some, ids[ids != self._line], np.diff(end, prepend=-1) - 1)
        for m in matches:
            if m.isspace():
                ids = self._plain(m)
                self._tokens.add([m], ids, np.array([len(ids)]))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of " " + word of distinct words one after the other, and how many each has."""
        out, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), 1 << 16):
            some = words[i:i + (1 << 16)]
            if len(self._tokens) > self._most or self._chars > self._most_chars:
                self._forget()
            heads, more, at, n = [" " + w for w in some], [], [], []    # first matches; the others, word by word
            for k, w in enumerate(some):
                if w.isalpha():
                    continue
                stem = w.rstrip(punctuation)
                if stem.isalpha():      # after letters, marks to the word's end are one match
                    heads[k] = " " + stem
                    more.append(w[len(stem):])
                    n.append(2)
                else:
                    heads[k], *rest = self._matches(heads[k])
                    more += rest
                    n.append(1 + len(rest))
                at.append(k)
            count = np.ones(len(some), dtype=np.int64)
            count[at] = n
            first = np.cumsum(count) - count
            other = np.ones(int(count.sum()), dtype=bool)
            other[first] = False
            rows = np.empty(len(other), dtype=np.int64)
            rows[first] = self._tokens.rows(heads, self._encode)
            rows[other] = self._tokens.rows(more, self._encode)
            ids, size = self._tokens.gather(rows)
            out.append(ids)
            sizes.append(np.add.reduceat(size, first))
        return np.concatenate(out), np.concatenate(sizes)

    def _parts(self, text: str) -> tuple[str, list[str]]:
        """What goes before the first place to cut, and the words after the others."""
        if self._added is not None and self._added.search(text):
            return text, []
        first, *rest = _GAP.split(text)
        return first, [r[1:] for r in rest]

    def _cut(self, texts: pa.Array) -> tuple[list[str], list[pa.Array], np.ndarray, np.ndarray]:
        """The texts' first parts, arrays of words, and where in these a text's words begin and end."""
        plain = [not _MIXED.search(t) and not (self._added is not None and self._added.search(t)) for t in texts.to_pylist()]
        split = pc.split_pattern(texts if all(plain) else pc.if_else(pa.array(plain), texts, ""), " ")
        words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        firsts = words.take(pa.array(offsets[:-1])).to_pylist()
        start, end = offsets[:-1] + 1, offsets[1:].copy()
        out, n = [words], len(words)
        for i in np.flatnonzero(~np.array(plain, dtype=bool)).tolist():
            firsts[i], rest = self._parts(texts[i].as_py())
            out.append(pa.array(rest, words.type))
            start[i], end[i] = n, n + len(rest)
            n += len(rest)
        return firsts, out, start, end

    def __call__(self, texts: list[str | None] | pa.ChunkedArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and the lengths with it."""
        if isinstance(texts, list):
            texts = pa.chunked_array([pa.array(texts, pa.large_string())])
        kind = pa.string() if texts.nbytes < 1 << 30 else pa.large_string()     # words are numbered faster with short offsets
        firsts, words, spans, at = [], [], [], 0
        for i in range(0, len(texts), 256):
            first, cut, lo, hi = self._cut(pa.concat_arrays(texts[i:i + 256].cast(kind).chunks).fill_null(""))
            spans.append((len(firsts), (lo + at).tolist(), (hi + at).tolist()))
            firsts += first
            words += cut
            at += sum(map(len, cut))
        coded = pa.chunked_array(words, kind).dictionary_encode()
        del words
        ids, size = self._encoded(coded.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist() if coded.num_chunks else [])
        rows = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.empty(0, np.int32)])
        del coded
        # after the words' ids come those of what begins a text, then the end id
        row_of = {t: len(size) + k for k, t in enumerate(dict.fromkeys(firsts))}
        begun = [self._plain(t) if t else ids[:0] for t in row_of]
        ids = np.concatenate([ids, *begun, np.array([end], dtype=np.int32)])
        size = np.concatenate([size, np.array([*map(len, begun), 1], dtype=np.int64)])
        held = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), ids)
        first_rows = np.fromiter(map(row_of.__getitem__, firsts), dtype=np.int32, count=len(firsts))
        stop = np.array([len(size) - 1], dtype=np.int32)
        out, lengths = [ids[:0]], [size[:0]]
        for k, lo, hi in spans:
            parts = []
            for j, (a, b) in enumerate(zip(lo, hi, strict=True), k):
                parts += [first_rows[j:j + 1], rows[a:b], stop]
            taken = np.concatenate(parts)
            out.append(held.take(pa.array(taken)).flatten().to_numpy())
            n = np.array(hi) - np.array(lo) + 2
            lengths.append(np.add.reduceat(size[taken], np.cumsum(n) - n))
        return np.concatenate(out).view(np.uint32), np.concatenate(lengths)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer_file: str) -> Encoder:
    """The worker's encoder; what it holds is bounded in words and characters and serves the next task."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def _packer(tokenizer_file: str, folder: str, end: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        encode = _encoder(tokenizer_file)
        ids, doc_ids, known, lengths = [], [], [], []
        def encoded(texts: list[pa.Array]) -> None:
            gc.disable()                # the library gives a small list a match, and none is part of a cycle
            try:
                one, n = encode(pa.chunked_array(texts), end)
            finally:
                gc.enable()
            ids.append(one.astype(np.uint16) if one.size and one.max() < 1 << 16 else one)
            lengths.append(n)

        waiting, size = [], 0
        for b in batches:
            waiting.append(b.column(1))
            size += b.column(1).nbytes
            if size >= SHARD_BYTES:
                encoded(waiting)
                waiting, size = [], 0
            doc_ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known.append(b.column(0).is_valid().to_numpy(zero_copy_only=False))
        if not doc_ids or not sum(map(len, doc_ids)):
            return
        if waiting:
            encoded(waiting)
        doc_ids = np.concatenate(doc_ids)
        blob = WaveletMatrix.pack(np.concatenate(ids), doc_ids, np.concatenate(lengths), np.concatenate(known))
        # a task that runs twice writes two files; the row that Spark keeps names one of them
        name = f"{folder}/shard-{uuid.uuid4().hex}.wvm"
        store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(path) as out:
            out.write(blob)
        n = int(sum(x.sum() for x in lengths))
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [n], "bytes": [len(blob)]})
    return run


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None, id_col: str = "doc_id",
                      text: str = "text", end: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards below ``folder`` (a shared one) and returns their manifest, saved as a table:
    shard (long, in id order), file, n_docs, n_ids, bytes, start (ids in all shards before).

    * NULL ids come first; rows with the same id are in order of their texts' hashes.
    * NULL and empty texts are documents of the end id alone.
    * ``shard_bytes`` of text make a shard, so a task's memory is bounded by that and the longest text.
    * An empty table gives an empty manifest. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    total = d.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    folder = (folder or scratch_path(docs.sparkSession, "token_files")).replace("file:///", "/", 1)
    # rows of one id may fill shards: they are cut by their texts' hashes, equal rows by their place
    d = d.select("id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    order = (F.col("id").asc_nulls_first(), "_h", "_i")
    written = d.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = written.select("id", "text").mapInArrow(
        _packer(tokenizer_file, folder, end), "file string, n_docs long, n_ids long, bytes long")
    # the range partitioner numbers partitions in id order
    made = saved(made.select(F.spark_partition_id().cast("long").alias("shard"), "*"), "token_manifest")
    return saved(running_offsets(made, "shard", "n_ids", "start"), "token_manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    from pyarrow import fs
    for b in batches:
        for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
            with store.open_input_stream(path) as f:
                w = WaveletMatrix(f.read())
            ids = w.all_ids().astype("<u4", copy=False)
            doc_ids, lengths, known = w.documents()
            ends = np.cumsum(lengths)
            sums = [crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, mask=~known), "start": start + ends - lengths,
                "n_tokens": lengths, "ids_crc32": pa.array(sums, pa.int64())})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    n = max(1, manifest.count())
    return (manifest.select("file", "start").repartition(n, "file")
            .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long"))
