"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words hash into ``buckets`` bins. Two multinomials
over the bins are estimated from whole tables: one over the trusted documents and
one over all documents. A document's score is the mean, over its n-grams, of
``ln p_trusted(bin) - ln p_raw(bin)``; it is kept when the score reaches
``min_ratio``, always the same way (no sampling).

:func:`quality_rules_counted` has no bins: it counts every n-gram by its 64-bit hash in a
table that grows with the corpus, and joins that table to the texts.

Everything is a DataFrame expression. The driver holds ``buckets`` doubles, or the weights
of the ``common_grams`` most frequent n-grams; the others never leave the executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, saved, words_of

BUCKETS = 1 << 14
MIN_RATIO = -0.12
PRIOR = 3.0             # added to both counts of a weight: an n-gram of a few texts weighs little
MIN_SCORE = -0.25       # of the counted score, from labelled texts scored by the half they are not in
COMMON_GRAMS = 1 << 16
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _doubled(h: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _bins(h: Column, pairs: Column, buckets: int) -> Column:
    """Bins of the words and of the pairs of neighbours, from their hashes."""
    return F.transform(F.concat(h, pairs), lambda v: F.pmod(v, F.lit(buckets)).cast("int"))


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_h`` and ``_h2``, the hashes of the words and of the pairs of neighbours."""
    d = docs.select("*", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_h"))
    return d.select("*", _doubled(F.col("_h"), 1).alias("_h2"))


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text: str, most_sent: int) -> DataFrame:
    """(_id, _x, _t): ids and texts, with the id once more where it is trusted."""
    marks = trusted.select(F.col(id_col).alias("_t")).where("_t IS NOT NULL").distinct()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x"))
    if marks.limit(most_sent + 1).count() <= most_sent:   # else Spark shuffles both sides
        marks = F.broadcast(marks)
    return base.join(marks, F.col("_id") == F.col("_t"), "left")


def ngram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS, most_sent: int = 1_000_000) -> list[float]:
    """``ln p_trusted - ln p_raw`` of each bin, both with one added to every count.

    ``trusted`` holds ids; a NULL id is never trusted and a repeated one counts once.
    With no trusted text all weights are 0. Up to ``most_sent`` trusted ids (8 bytes each)
    are broadcast, so that the texts stay where they are; above that both sides shuffle."""
    counted = (_hashed(_marked(docs, trusted, id_col, text, most_sent), "_x")
               .select(F.col("_t").isNotNull().alias("good"), F.explode(_bins(F.col("_h"), F.col("_h2"), buckets)).alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("raw"),
                                   F.count(F.when(F.col("good"), 1)).alias("good")).collect())  # <= buckets rows
    raw, good = [1] * buckets, [1] * buckets
    for r in counted:
        raw[r["bin"]] += r["raw"]
        good[r["bin"]] += r["good"]
    if sum(good) == buckets:
        return [0.0] * buckets
    lr, lg = math.log(sum(raw)), math.log(sum(good))
    return [math.log(g) - lg - math.log(r) + lr for g, r in zip(good, raw, strict=True)]


def _fold(text: Column) -> Column:
    """0 or 1: the half of the corpus that a text belongs to; equal texts share it."""
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(2)).cast("int")


def gram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                 most_sent: int = 1_000_000, prior: float = PRIOR) -> DataFrame:
    """The table (gram, raw, w0, w1) of the n-grams by their 64-bit hashes: ``w0`` weighs them
    in texts of half 0 and comes from the counts of half 1, ``w1`` the other way round. So no
    text and no copy of it, nor its own label, has a part in its own score.

    The weight is ``ln (good + prior) / (raw * G / R + prior)``: what the trusted texts of a
    half hold of the n-gram over what they would hold if they were like all its texts (G of
    its R n-grams are theirs). It is 0 for an n-gram that the half does not hold, and n-grams
    of one half alone are not in the table."""
    total = F.array(F.lit(None).cast("long"))       # one place more a text, whose count is that of its n-grams
    marked = _hashed(_marked(docs, trusted, id_col, text, most_sent), "_x")
    grams = (marked
             .select((2 * _fold(F.col("_x")) + F.col("_t").isNotNull().cast("int")).alias("part"),
                     (F.size("_h") + F.size("_h2")).alias("n"),
                     F.concat("_h", "_h2", total).alias("_g"))      # beside explode, n would be made for each place
             .select("part", "n", F.explode_outer("_g").alias("gram"))
             .withColumn("n", F.when(F.col("gram").isNull(), F.col("n")).otherwise(1).cast("long")))
    has = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    part = F.col("part")
    counted = grams.groupBy("gram").agg(has(part < 2).alias("raw0"), has(part == 1).alias("good0"),
                                        has(part >= 2).alias("raw1"), has(part == 3).alias("good1"))
    table = saved(counted.where("(raw0 > 0 AND raw1 > 0) OR gram IS NULL"), "grams")
    whole = table.where("gram IS NULL").first()

    def weight(half: int) -> Column:
        share = whole[f"good{half}"] / whole[f"raw{half}"] if whole and whole[f"raw{half}"] else 0.0
        return F.log((F.col(f"good{half}") + prior) / (F.col(f"raw{half}") * F.lit(share) + prior))
    return table.where("gram IS NOT NULL").select("gram", (F.col("raw0") + F.col("raw1")).alias("raw"),
                                                  weight(1).alias("w0"), weight(0).alias("w1"))


def _common(table: DataFrame, most: int) -> tuple[Column, list[Column], int]:
    """The most frequent n-grams as literals, hashes and the halves' weights by slot, and the
    slots. Of n-grams with one slot the most frequent has it; the others are looked up by the join."""
    slots = 2 * most
    grams, weights = [None] * slots, [[None] * slots, [None] * slots]
    for r in table.orderBy(F.desc("raw"), "gram").limit(most).collect():
        at = r["gram"] % slots
        if grams[at] is None:
            grams[at], weights[0][at], weights[1][at] = r["gram"], r["w0"], r["w1"]
    literal = lambda x, t: F.from_json(F.lit(json.dumps(x)), f"array<{t}>")
    return literal(grams, "bigint"), [literal(w, "double") for w in weights], slots


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), ``_h``, ``_h2``.

    A window's hash joins two halves' hashes: pairs, then fours, then eights."""
    x = F.coalesce(F.col(text), F.lit(""))
    d = _hashed(docs, text)
    d = d.select("*", _doubled(_doubled(F.col("_h2"), 2), 4).alias("_w"),
                 F.filter(F.split(x, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    twice = F.size("_w") > F.size(F.array_distinct("_w"))
    # sorted (hash, place) pairs: a window that occurs twice stands beside its equal
    placed = F.array_sort(F.transform("_w", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    d = d.withColumn("_s", F.when(twice, placed))
    s = F.col("_s")
    same = lambda e, j: (F.get(s, j - 1)["v"] == e["v"]) | (F.get(s, j + 1)["v"] == e["v"])
    d = d.withColumn("_p", F.array_sort(F.transform(
        F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda v, j: F.least(F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0), lambda a, v: a + v)
    return d.select(
        *[f"`{c}`" for c in docs.columns], "_h", "_h2",
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.regexp_replace(x, GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(x, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _verdict(d: DataFrame, id_col: str, least: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), "llr", (~failed & (F.col("llr") >= F.lit(least))).alias("kept"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the base counts, base_failed, llr, kept.

    * NULL or empty text: no words, base_failed, llr 0, not kept.
    * NULL ids and repeated rows are scored like any other row.
    * Very long texts: arrays inside one row, n log n in its words.
    * An empty ``trusted`` table: every weight is 0, so ``kept`` is ``not base_failed``
      (for ``min_ratio`` <= 0). An empty ``docs`` gives an empty result.
    * Other columns of ``docs`` are not read, so their names cannot clash.
    """
    weights = ngram_weights(docs, trusted, id_col, text, buckets)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")   # folded to one literal
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x"))
    d = base_counts(base, "_x")
    bins = _bins(F.col("_h"), F.col("_h2"), buckets)
    total = F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.get(table, b))
    d = d.select("*", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("llr"))
    return _verdict(d, id_col, min_ratio)


def quality_rules_counted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                          min_score: float = MIN_SCORE, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """:func:`quality_rules` by the weights of :func:`gram_weights`, which are those of single
    n-grams at every size of ``docs``; ``llr`` is their mean over a text.

    The most frequent n-grams are added up where the text is. The others, one row for each
    place, are joined on the hash with the weights. Texts are named by their hashes, so equal
    texts have one mean. No n-gram that the join sees holds a large share of the rows."""
    table = gram_weights(docs, trusted, id_col, text)
    grams, weights, slots = _common(table, common_grams)
    slot = lambda v: F.pmod(v, F.lit(slots)).cast("int")
    is_common = lambda v: F.coalesce(F.get(grams, slot(v)) == v, F.lit(False))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x"))
    name = F.xxhash64("_x", F.length("_x")).alias("_name")
    fold = _fold(F.col("_x")).alias("_f")
    # beside explode, the name would be made for each place; explode, not outer, would make the array twice
    rare = (_hashed(base, "_x").select(name, fold, F.filter(F.concat("_h", "_h2"), lambda v: ~is_common(v)).alias("_g"))
            .select("_name", "_f", F.explode_outer("_g").alias("gram")))
    found = rare.join(table.select("gram", "w0", "w1"), "gram").select("_name", F.when(F.col("_f") == 0, F.col("w0")).otherwise(F.col("w1")).alias("_w"))
    sums = found.groupBy("_name").agg(F.sum("_w").alias("_rare"), F.count(F.lit(1)).alias("_n"))
    # equal texts have one name: their places were added up together
    each = F.concat("_h", "_h2")
    own = lambda f: F.aggregate(each, F.lit(0.0), lambda a, v: a + F.when(is_common(v), F.get(weights[f], slot(v))).otherwise(0.0))
    d = base_counts(base, "_x").select("*", name, F.when(fold == 0, own(0)).otherwise(own(1)).alias("_sum")).drop("_x", "_h", "_h2")
    d = saved(d, "rules")                                   # no text; later filters do not reach the expressions
    copies = d.groupBy("_name").agg(F.count(F.lit(1)).alias("_copies"))
    d = d.join(sums.join(copies, "_name").select("_name", (F.col("_rare") / F.col("_copies")).alias("_rare")), "_name", "left")
    total = F.col("_sum") + F.coalesce("_rare", F.lit(0.0))
    d = d.select("*", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("llr"))
    return _verdict(d, id_col, min_score)
