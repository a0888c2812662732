"""Fill-in-middle transformation by block rotation inside one buffer.

A text is cut into prefix, middle and suffix. Its UTF-8 bytes are scanned for the cuts,
the sentinels are inserted before the three segments in a bytearray, and the segments
change places there by rotations, each made of three reversals: reversing two neighbouring
blocks and then both together swaps them, in place and in time linear in their length.

    psm: <P>prefix | <M>middle <S>suffix      ->  <P>prefix <S>suffix <M>middle
    spm: <P>prefix <M>middle | <S>suffix      ->  <S>suffix <P>prefix <M>middle

A rotation is undone by the opposite rotation, so output and form give back the text: a
text that holds a sentinel stays plain, hence each sentinel stands in an output once (no
sentinel begins with the end of another).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FIM_PERCENT, SPM_PERCENT = 90, 20
_SLAB = 1 << 16


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Swaps the blocks [lo, mid) and [mid, hi) of ``buf`` in place by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        half = (b - a) // 2
        for s in range(0, half, _SLAB):         # the ends change places, a slab at a time
            n = min(_SLAB, half - s)
            left = view[a + s:a + s + n].copy()
            view[a + s:a + s + n] = view[b - s - n:b - s][::-1]
            view[b - s - n:b - s] = left[::-1]


def scan_cuts(raw: bytes, cuts: tuple[int, int]) -> tuple[int, int]:
    """Byte places before the code points number ``cuts`` (ascending, from 0) of a text's UTF-8."""
    if raw.isascii():
        return cuts
    view, out, seen, at, want = np.frombuffer(raw, np.uint8), [], 0, 0, list(cuts)
    while want and at < len(raw):
        starts = np.flatnonzero((view[at:at + _SLAB] & 0xC0) != 0x80)
        while want and want[0] < seen + len(starts):
            out.append(at + int(starts[want.pop(0) - seen]))
        seen += len(starts)
        at += _SLAB
    return tuple(out + [len(raw)] * len(want))


def transform(raw: bytes, form: str, prefix: int, middle: int) -> bytearray:
    """A text's bytes, whose prefix and middle have so many code points, in the form's order."""
    if form == PLAIN:
        return bytearray(raw)
    cut, stop = scan_cuts(raw, (prefix, prefix + middle))
    buf = bytearray(raw)
    buf[stop:stop] = SUFFIX
    buf[cut:cut] = MIDDLE
    buf[0:0] = PREFIX
    cut, stop = cut + len(PREFIX), stop + len(PREFIX) + len(MIDDLE)      # where <M> and <S> stand now
    rotate(buf, cut if form == PSM else 0, stop, len(buf))
    return buf


def restore(output: bytes, form: str) -> bytes:
    """The exact text from an output and its form."""
    buf = bytearray(output)
    if form == PLAIN:
        return bytes(buf)
    m = buf.find(MIDDLE)
    if form == PSM:
        s = buf.find(SUFFIX)
        rotate(buf, s, m, len(buf))                        # <S>suffix, <M>middle change places again
        cut, stop = s, s + len(buf) - m
    else:
        p = buf.find(PREFIX)
        rotate(buf, 0, p, len(buf))
        cut, stop = m - p, len(buf) - p
    del buf[stop:stop + len(SUFFIX)]
    del buf[cut:cut + len(MIDDLE)]
    del buf[:len(PREFIX)]
    return bytes(buf)


def plan(key: str, n: int, raw: bytes, seed: str = "1", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple:
    """(form, prefix, middle) of the document with that key and ``n`` code points."""
    h = sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not n or h3 % 100 >= fim or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < spm else PSM, lo, hi - lo


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1",
                   fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (code points of the text), form (plain, psm or spm), prefix_chars and
    middle_chars (NULL if plain) and fim_text, the transformed text; columns of these names
    are replaced.

    The document's id decides form and cuts (a NULL id counts as an empty one), so reruns
    and rows with the same id and text agree. ``fim`` per cent of the documents are
    transformed, ``spm`` per cent of those suffix first.

    * NULL and empty texts, and texts that hold a sentinel, are plain; NULL counts as empty.
    * Whole texts are cut; memory follows the longest text. An empty table stays empty.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "fim_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                raw = raw or b""
                n = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
                form, prefix, middle = plan(key or "", n, raw, seed, fim, spm)
                rows.append((n, form, prefix, middle, bytes(transform(raw, form, prefix, middle))))
            made = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(made, types, strict=True)]
            cols[4] = cols[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], names=[*batch.schema.names[2:], *added])

    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    sent = docs.select(F.col(f"`{id_col}`").cast("string").alias("_key_in"), F.col(f"`{text}`").alias("_text_in"), *rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[2:])
    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, fim_text string"
    return sent.mapInArrow(run, f"{fields}, {schema}" if fields else schema)


def restored(fim: DataFrame, output: str = "fim_text", form: str = "form", out: str = "restored") -> DataFrame:
    """``fim`` with ``out``, the text rebuilt from output and form alone; NULL stays NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if raw is None else restore(raw, f or PLAIN) for raw, f in
                     zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            back = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], back], names=[*batch.schema.names[2:], out])

    bounded_batches(fim.sparkSession)
    rest = [F.col(f"`{c}`") for c in fim.columns if c.lower() != out.lower()]
    sent = fim.select(F.col(f"`{output}`").alias("_output_in"), F.col(f"`{form}`").alias("_form_in"), *rest)
    return sent.mapInArrow(run, sent.drop("_output_in", "_form_in").schema.add(out, "string"))


def fim_digest(docs: DataFrame) -> DataFrame:
    made = restored(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS p4 FROM d),
f AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain'
              WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
         ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
