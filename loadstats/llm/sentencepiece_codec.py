"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a vocabulary that occur in a text form a lattice over its characters. The
forward pass (Viterbi) gives every place the score of the best way to it. The backward
pass is an A* search from the end of the text: a partial path's score plus the forward
score of the place it has reached is exactly the score of its best completion, so
complete paths leave the queue in N-best order.

No piece has a space after another character, so no path crosses the place before a
space that follows a non-space: the lattice is a chain of small ones. A text's best path
joins theirs, and its N best differ from it only in the ``N - 1`` parts whose second best
is nearest to their best. The forward pass runs over many distinct parts at once in
numpy; the search runs where a runner-up is needed.

The vocabulary files hold merge ranks instead of probabilities; a piece of rank r counts
as ``-ln(r + 2)`` (Zipf's law). Characters that no piece covers are written as byte
pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HeldIds, bounded_batches, forgettable, releasing

N_BEST = 4
LONGEST = 24            # characters of a part that the batched pass takes
SHORT = 256          # up to this length a part's pieces are looked up one by one
_PARTS = re.compile(r" *[^ ]+| +")


def _hash_chars(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c + np.uint64(0x9E3779B9))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.score, self.id, self.byte = {}, {}, {}
        self.text: list[str | int | None] = [None] * n          # of each id: its text, its byte, or nothing
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                if re.search(r"[^ ] ", piece):
                    raise ValueError(f"piece {i} has a space after another character")
                self.id[piece], self.score[piece] = i, -math.log(2.0 - sp.get_score(i))
                self.text[i] = piece
        self._bytes = pa.array([b"" if t is None else bytes([t]) if isinstance(t, int) else t.encode() for t in self.text],
                               pa.binary())
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, self.id))
        self.byte_score = -math.log(n) - 4.0
        # pieces by a hash of their characters, for the batched pass
        by_size: dict[int, list[str]] = {}
        for p in self.id:
            by_size.setdefault(len(p), []).append(p)
        hashes, ids = [], []
        for size, same in by_size.items():
            c = np.frombuffer("".join(same).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size).astype(np.uint64)
            h = np.zeros(len(same), dtype=np.uint64)
            for j in range(size):
                h = _hash_chars(h, c[:, j])
            hashes.append(h)
            ids += [self.id[p] for p in same]
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        self._keys = hashes[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces hash alike")
        self._ids = np.array(ids, dtype=np.int32)[order]
        self._scores = np.array([self.score[self.text[i]] for i in self._ids.tolist()])
        self._slots = self._placed(self._keys)
        self._plain = frozenset(p for p in self.id if len(p) == 1) | {chr(i) for i in range(128)}
        self._byte_ids = np.array([self.byte[i] for i in range(256)])
        self.forget()

    @staticmethod
    def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two tables of 2**20 places: each key's index stands at its first or its second place."""
        one, two = np.zeros(1 << 20, np.uint16), np.zeros(1 << 20, np.uint16)
        if len(keys) > 1 << 16:
            one, two = one.astype(np.int32), two.astype(np.int32)
        a, b = keys >> np.uint64(44), keys & np.uint64((1 << 20) - 1)
        one[a] = np.arange(len(keys))
        late = np.flatnonzero(one[a] != np.arange(len(keys)))
        two[b[late]] = late
        if (two[b[late]] != late).any():
            raise ValueError("pieces clash in both tables")
        return one, two

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the piece, whether there is one) for hashes of characters."""
        one, two = self._slots
        at = one[h >> np.uint64(44)]
        hit = self._keys[at] == h
        miss = np.flatnonzero(~hit)
        again = two[h[miss] & np.uint64((1 << 20) - 1)]
        found = self._keys[again] == h[miss]
        at[miss[found]] = again[found]
        hit[miss[found]] = True
        return at, hit

    def forget(self) -> None:
        """Drops the parts held; the vocabulary itself stays."""
        self._ranked: dict[str, list] = {}
        self._held = HeldIds()                      # by part without its first space
        self._value = np.empty((1 << 12, 2))        # of each part held: best score, gap to the second best

    def _hold(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        rows = self._held.add([p[1:] for p in parts], ids, sizes)
        while rows[-1] >= len(self._value):
            self._value = np.concatenate([self._value, np.empty_like(self._value)])
        self._value[rows] = values

    # -- one part -----------------------------------------------------------------

    def _lattice(self, part: str) -> list[list[tuple[int, float, int]]]:
        """For every place of a part the lattice's edges (from, score, piece) that end there;
        the piece of a character that none covers is -1, for its bytes."""
        n = len(part)
        into: list[list] = [[] for _ in range(n + 1)]
        if n <= SHORT:                                          # too few places to be worth arrays
            for size in range(1, min(n, self.longest) + 1):
                for i in range(n - size + 1):
                    piece = self.id.get(part[i:i + size])
                    if piece is not None:
                        into[i + size].append((i, self.score[part[i:i + size]], piece))
        else:
            self._long_edges(part, into)
        for j in range(1, n + 1):
            if not any(i == j - 1 for i, _, _ in into[j]):
                into[j].append((j - 1, self.byte_score * len(part[j - 1].encode("utf-8", "replace")), -1))
        return into

    def _long_edges(self, part: str, into: list[list]) -> None:
        """The edges of a long part, all places at once."""
        n = len(part)
        c = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = _hash_chars(h[:n - size + 1], c[size - 1:])
            at, hit = self._find(h)
            start = np.flatnonzero(hit)
            pieces = at[start]
            for i, s, piece in zip(start.tolist(), self._scores[pieces].tolist(), self._ids[pieces].tolist(), strict=True):
                if self.text[piece] == part[i:i + size]:        # the hash proposes, the text decides
                    into[i + size].append((i, s, piece))

    @staticmethod
    def _forward(into: list) -> tuple[list[float], list[int]]:
        """The best score of every place, and which of its edges it comes by."""
        best, by = [0.0], [0]
        for edges in into[1:]:
            top, which = -math.inf, 0
            for k, (i, s, _) in enumerate(edges):
                if best[i] + s > top:
                    top, which = best[i] + s, k
            best.append(top)
            by.append(which)
        return best, by

    def forward(self, part: str) -> list[float]:
        return self._forward(self._lattice(part))[0]

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a part, best first: A* backwards from its end.

        The queue is ordered by what a partial path has lost against the best path: an edge
        loses ``best[to] - (best[from] + score)``, which is exactly 0 on the edge that the
        forward score came by. So a path that leaves the queue runs down to the start without
        further loss, whatever the length, and its total is that of its best completion. On
        the way down it leaves its detours in the queue; of those only the ``n`` least are
        kept, since each of them is the beginning of another complete path."""
        into = self._lattice(part)
        best, by = self._forward(into)
        queue: list[tuple[float, int, int, object]] = [(0.0, 0, len(part), None)]   # (loss, made, place, edges after it)
        losses: list[float] = []            # the least losses of detours so far, greatest first (negated)
        out: list[tuple[float, tuple[int, ...]]] = []
        made = 0
        while queue and len(out) < n:
            loss, _, at, path = heapq.heappop(queue)
            while at:
                edges, top = into[at], best[at]
                for k, (i, s, piece) in enumerate(edges):
                    if k == by[at]:
                        continue
                    total = loss + (top - (best[i] + s))
                    if len(losses) < n or total < -losses[0]:
                        (heapq.heappush if len(losses) < n else heapq.heappushpop)(losses, -total)
                        made += 1
                        heapq.heappush(queue, (total, made, i, ((at, piece), path)))
                i, _, piece = edges[by[at]]
                path = ((at, piece), path)
                at = i
            ids: list[int] = []
            while path is not None:
                (to, piece), path = path
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.byte[b] for b in part[to - 1].encode("utf-8", "replace")]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    # -- many parts ---------------------------------------------------------------

    def _batched(self, parts: list[str]) -> None:
        """Best path, score and gap to the second best of parts of one length."""
        size = len(parts[0])
        u = len(parts)
        c = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(u, size).astype(np.uint64)
        none = -math.inf
        edge = {}
        for i in range(size):
            h = np.zeros(u, dtype=np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = _hash_chars(h, c[:, j - 1])
                at, hit = self._find(h)
                if j == i + 1:
                    s = np.where(hit, self._scores[at], self.byte_score)
                    edge[i, j] = s, np.where(hit, self._ids[at], -1 - c[:, i].astype(np.int64))
                elif hit.any():
                    edge[i, j] = np.where(hit, self._scores[at], none), self._ids[at]
        to = np.full((size + 1, u), none)
        back = np.zeros((size + 1, u), dtype=np.int64)
        to[0] = 0
        for j in range(1, size + 1):
            for i in range(j):
                if (i, j) in edge:
                    t = to[i] + edge[i, j][0]
                    better = t > to[j]
                    to[j][better] = t[better]
                    back[j][better] = i
        onward = np.full((size + 1, u), none)
        onward[size] = 0
        for i in range(size - 1, -1, -1):
            for j in range(i + 1, size + 1):
                if (i, j) in edge:
                    np.maximum(onward[i], edge[i, j][0] + onward[j], out=onward[i])
        # walk the best path; every other path has an edge that is not on it
        at = np.full(u, size)
        ends = np.zeros((size + 1, u), dtype=bool)
        for j in range(size, 0, -1):
            ends[j] = at == j
            at = np.where(ends[j], back[j], at)
        none_id = np.iinfo(np.int64).min
        ids = np.full((u, size), none_id)
        second = np.full(u, none)
        for (i, j), (s, piece) in edge.items():
            on = ends[j] & (back[j] == i)
            ids[on, j - 1] = piece[on]
            np.maximum(second, np.where(on, none, to[i] + s + onward[j]), out=second)
        on = ids != none_id
        flat = ids[on]
        flat = np.where(flat < 0, self._byte_ids[np.maximum(-1 - flat, 0) & 255], flat)
        self._hold(parts, flat, on.sum(axis=1), np.stack([to[size], np.maximum(to[size] - second, 0.0)], axis=1))

    def _learn(self, parts: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for p in parts:
            if len(p) <= LONGEST and self._plain.issuperset(p):
                by_size.setdefault(len(p), []).append(p)
            else:
                ways = self._best_of(p, N_BEST)                 # searched once, also for its runners-up
                a, b = (*ways, (-math.inf, ()))[:2]
                self._hold([p], np.array(a[1]), np.array([len(a[1])]), np.array([[a[0], a[0] - b[0]]]))
        for same in by_size.values():
            for lo in range(0, len(same), 2048):
                self._batched(same[lo:lo + 2048])

    def _best_of(self, part: str, n: int) -> list:
        if len(self._ranked) > 20_000:
            self._ranked.clear()
        if len(self._ranked.get(part, ())) != n:
            self._ranked[part] = self.search(part, n)
        return self._ranked[part]

    # -- whole texts --------------------------------------------------------------

    @staticmethod
    def parts_of(text: str) -> list[str]:
        """A text's parts, each without its first space (one space is put before the text)."""
        if "  " in text or text.startswith(" "):
            return [p[1:] for p in _PARTS.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str | None], n: int = N_BEST, most_held: int = 250_000) -> list[tuple]:
        """For each text (ids as an int32 array, scores of the up to ``n`` best, others).

        ``others`` are the runners-up as changes to the best: lists of (at, length, ids),
        the ids that stand in place of ``length`` ids of the best from ``at`` on."""
        if len(self._held) > most_held:
            self.forget()
        split = [self.parts_of(t) if t else [] for t in texts]
        all_rows = self._held.rows([p for parts in split for p in parts], lambda new: self._learn([" " + p for p in new]))
        all_values = self._value[all_rows]
        out, at = [], 0
        for parts in split:
            if not parts:
                out.append((np.empty(0, np.int32), [0.0], []))
                continue
            rows, values = all_rows[at:at + len(parts)], all_values[at:at + len(parts)]
            at += len(parts)
            ids, sizes = self._held.gather(rows)
            score, gaps = float(values[:, 0].sum()), values[:, 1]
            few = min(n - 1, len(gaps))
            near = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1]) if few else np.empty(0, np.int64)
            near = near[np.argsort(gaps[near], kind="stable")][:few]
            ways = [(0.0, ())]                  # (loss, ((part, way), ...)), best first
            ranked = {}
            for k in sorted(near.tolist()):
                ranked[k] = best = self._best_of(" " + parts[k], n)
                choice = [(0.0, ())] + [(best[0][0] - r[0], ((k, w),)) for w, r in enumerate(best) if w]
                ways = sorted(((round(a + b, 9), x + y) for a, x in ways for b, y in choice))[:n]
            others = [[(int(sizes[:k].sum()), int(sizes[k]), list(ranked[k][w][1])) for k, w in way] for _, way in ways[1:]]
            out.append((ids, [score - loss for loss, _ in ways], others))
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: the pieces' bytes one after the other, without the first
        space. Control pieces give nothing; what is not UTF-8 becomes U+FFFD."""
        flat = ids.flatten()
        made = self._bytes.take(flat)                       # its bytes lie one after the other
        ends = np.frombuffer(made.buffers()[1], dtype=np.int32)[made.offset:made.offset + len(made) + 1]
        cut = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        raw = made.buffers()[2].to_pybytes() if made.buffers()[2] is not None else b""
        at = ends[cut].tolist()
        texts = [raw[lo + (raw[lo:lo + 1] == b" " and lo < hi):hi].decode("utf-8", "replace")
                 for lo, hi in zip(at, at[1:], strict=False)]
        return pa.array(texts, pa.string(), mask=np.array(ids.is_null()))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _VOCABULARIES:
        _VOCABULARIES[model_file] = forgettable(Vocabulary(model_file))
    return _VOCABULARIES[model_file]


@lru_cache(maxsize=4)
def _piece_bytes(model_file: str) -> str:
    """The bytes of every id's piece, as a JSON array of hexadecimal strings; control pieces have none."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def one(i: int) -> str:
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            return piece[3:5]
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            return ""
        return piece.replace("▁", " ").encode().hex()
    return json.dumps([one(i) for i in range(sp.get_piece_size())])


OTHERS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _encoder(model_file: str, n: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                made = v.encode(some.column(0).to_pylist(), n)
                flat = np.concatenate([m[0] for m in made])
                cut = np.cumsum([0] + [len(m[0]) for m in made])
                ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))
                others = pa.array([[[{"at": a, "length": k, "ids": x} for a, k, x in way] for way in m[2]] for m in made], OTHERS)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], ids, pa.array([m[1] for m in made], pa.list_(pa.float64())), others],
                    names=[*some.schema.names[1:], "ids", "scores", "others"])
    return run


def encode(docs: DataFrame, model_file: str, text: str = "text", n_best: int = N_BEST) -> DataFrame:
    """``docs`` with ids (array<int>, the best segmentation), scores (array<double>, of the
    up to ``n_best`` best, best first) and others (the runners-up, see
    :meth:`Vocabulary.encode`); columns of these names are replaced.

    * NULL and empty texts have no ids, one score of 0 and no others.
    * Whole texts are read; a part longer than ``LONGEST`` is searched by itself.
    * Rows are encoded alone: ties, repeats and NULLs elsewhere do not matter. A text with
      fewer segmentations than ``n_best`` has fewer scores.
    """
    bounded_batches(docs.sparkSession)
    taken = ("ids", "scores", "others")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    d = docs.select(F.col(f"`{text}`").alias("_text_in"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    schema = (fields + ", " if fields else "") + \
        "ids array<int>, scores array<double>, others array<array<struct<at:int,length:int,ids:array<int>>>>"
    return d.mapInArrow(_encoder(model_file, n_best), schema)


def decode(coded: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with ``out``, the text of its ids, added; NULL ids give a NULL text.

    The text is a DataFrame expression over the pieces' bytes, a literal of the vocabulary's
    size: it is made where :func:`encode` hands its rows over, and takes no Python worker
    beside the one that encodes."""
    pieces = F.from_json(F.lit(_piece_bytes(model_file)), "array<string>")
    rest = [F.col(f"`{c}`") for c in coded.columns if c.lower() != out.lower()]
    spelled = F.transform(F.col(f"`{ids}`").cast("array<int>"), lambda i: F.element_at(pieces, i + 1))
    text = F.make_valid_utf8(F.unhex(F.array_join(spelled, "")).cast("string"))
    return coded.select(*rest, F.regexp_replace(text, "^ ", "").alias(out))


def codec_digest(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash, best_score, n_best, gap (best to last of the N best) and
    round_trip (whether the ids decode to the text; NULL reads as empty)."""
    coded = decode(encode(docs.select("doc_id", "text"), model_file), model_file)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.round(F.get("scores", F.lit(0)), 6).alias("best_score"), F.size("scores").cast("long").alias("n_best"),
        F.round(F.get("scores", F.lit(0)) - F.element_at("scores", -1), 6).alias("gap"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
