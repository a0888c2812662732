"""Mixing sources to target weights by weighted fair queueing.

Each source serves its documents in a seeded shuffled order, pass after pass. Serving a
document costs its size; its virtual finish time is what its source has served by then,
divided by the source's weight. All entries are sorted by finish time and the queue is
cut where the total budget is used up. A source that has served its last pass leaves the
queue, and the others share what it would have had: exactly the reshared targets.

Weights are whole numbers, so times are whole numbers too (served words times the least
common multiple of the weights, over the weight): the order has no rounding and reruns
agree. Nothing is held per source but one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, saved, sendable

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)          # the budget as a fraction of all sizes
PASSES = 2
SEED = "mix-1"
BIN_ENTRIES = 1_000


def shuffle_key(id_col: Column, seed: str) -> Column:
    """Place of a document in its source's shuffled order: 60 bits of a seeded MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
                   passes: int = PASSES) -> DataFrame:
    """source, source_size, w, target, budget: one row per source.

    ``target`` is ``min(passes * source_size, w * level)`` with the level that makes the
    targets add up to the budget. Sources sorted by ``source_size / w`` fill up one after
    another; the level follows from the sums over those that are full."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # code point order of UTF-8 strings is their byte order; NULL is last
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.array(*[F.lit(int(x)) for x in weights])
    t = sums.select("source", "source_size", F.get(w, rank % len(weights)).cast("long").alias("w"))
    everyone = Window.partitionBy()
    full_first = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    full = full_first.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", _div(F.sum("source_size").over(everyone) * share[0], F.lit(share[1])).alias("budget"),
                 F.sum(F.col("source_size") * passes).over(full).alias("_full"),
                 (F.sum("w").over(everyone) - F.sum("w").over(full)).alias("_left"))
    # full when what is left, spread over the others, would still pass this source's cap
    exact = lambda c: c.cast("decimal(38,0)")
    over = exact(F.col("budget") - F.col("_full") + F.col("source_size") * passes) * F.col("w") >= \
        exact(F.col("source_size") * passes) * (F.col("_left") + F.col("w"))
    t = t.select("*", over.alias("_over"))
    taken = F.coalesce(F.sum(F.when(F.col("_over"), F.col("source_size") * passes)).over(everyone), F.lit(0))
    rest = F.sum(F.when(~F.col("_over"), F.col("w"))).over(everyone)
    return t.select("source", "source_size", "w", "budget",
                    F.when(F.col("_over"), (F.col("source_size") * passes).cast("double"))
                    .otherwise((F.col("budget") - taken) * F.col("w") / rest).alias("target"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source",
        weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES,
        seed: str = SEED) -> DataFrame:
    """One row per document: ``id_col``, source, size, twin (number among rows equal in these three),
    source_size, target, copies (passes it is in), taken.

    * NULL source: a source of its own, the last. NULL id: allowed, sorted by size.
    * Documents of size 0 (NULL or empty text) cost nothing and are never queued: copies 0.
    * Repeated ids or rows: each row is a document of its own; equal ones are served in order of size.
    * An empty table gives an empty result. Other columns are not read, so names cannot clash.
    * The queue ends before the entry that would pass the budget, so the mix falls short of
      it by less than one document, and each source of its target by less than one.
    """
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size"))
                  .withColumn("k", shuffle_key(F.col("id"), seed)), "mix")
    targets = saved(source_targets(sized, weights, share, passes), "mix_targets")
    scale = math.lcm(*[int(x) for x in weights])
    # Shuffled order: keys are uniform, so equal key ranges hold equal numbers of rows
    rows = sized.count()
    parts = max(1, math.ceil(rows / BIN_ENTRIES))
    cell = F.floor(F.col("k") / F.lit(math.ceil(2 ** 60 / parts)))
    queued = sized.where("size > 0").withColumn("cell", cell)
    per_cell = queued.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_cell.select("source", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("source", "cell").orderBy("k", "id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    served = (queued.withColumn("served", F.sum("size").over(inside))
              .join(bases.withColumnsRenamed({"source": "_s", "cell": "_c"}),
                    F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c"))).drop("_s", "_c")
              .join(targets.select(F.col("source").alias("_s"), "w", "source_size", "budget"),
                    F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    entries = served.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(
        "id", "source", "size", "k", "pass", "budget",
        ((F.col("served") + F.col("base") + F.col("pass") * F.col("source_size"))
         * _div(F.lit(scale), F.col("w"))).alias("finish"))
    # Equal spans of virtual time hold about equal numbers of words (each source serves its
    # weight in a unit of time): the range sort's partitions.
    entries = saved(entries, "mix_entries")
    last = entries.agg(F.max("finish")).first()[0] or 0
    entries = entries.withColumn("span", F.floor(F.col("finish") / F.lit(max(1, last // max(1, parts * passes) + 1))))
    spans = running_offsets(entries.groupBy("span").agg(F.sum("size").alias("n")), "span", "n", "base")
    order = (Window.partitionBy("span").orderBy("finish", F.col("source").isNull(), "source", "k", "id", "size", "pass")
             .rowsBetween(Window.unboundedPreceding, 0))
    taken = (entries.withColumn("upto", F.sum("size").over(order)).join(spans.select("span", "base"), "span")
             .where("upto + base <= budget"))
    copies = taken.groupBy("id", "source", "size", "k").agg(F.count(F.lit(1)).alias("n"))
    # rows that are equal in all of these share their copies evenly, the first ones more
    twins = Window.partitionBy("id", "source", "size", "k").orderBy("size")
    many = Window.partitionBy("id", "source", "size", "k")
    numbered = sized.withColumn("_i", F.row_number().over(twins)).withColumn("_n", F.count(F.lit(1)).over(many))
    c = copies.withColumnsRenamed({x: f"_{x}" for x in ("id", "source", "size", "k", "n")}).withColumnRenamed("_n", "_have")
    share_of = F.floor((F.coalesce("_have", F.lit(0)) + F.col("_n") - F.col("_i")) / F.col("_n"))
    out = numbered.join(c, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
                        & (F.col("size") == F.col("_size")) & (F.col("k") == F.col("_k")), "left")
    return (out.withColumn("copies", share_of)
            .join(targets.select(F.col("source").alias("_s"), "source_size", "target"),
                  F.col("source").eqNullSafe(F.col("_s")))
            .select(F.col("id").alias(id_col), F.col("source").alias(source), "size", F.col("_i").alias("twin"),
                    "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source", text: str = "text",
          **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as :func:`mix` takes it.

    Rows are matched by id; those whose id is NULL or repeated by id, source, size and
    their order by text among equals. Documents of size 0 are not in the mix."""
    taken = saved(mix(docs, size, id_col, source, **how).where("copies > 0")
                  .select(F.col(id_col).alias("_m_id"), F.col(source).alias("_m_source"), F.col("size").alias("_m_size"),
                          F.col("twin").alias("_m_twin"), F.col("copies").cast("int").alias("_m_copies")), "taken")
    odd = saved(docs.groupBy(F.col(id_col).alias("_m_odd")).agg(F.count(F.lit(1)).alias("_m_n"))
                .where("_m_n > 1 OR _m_odd IS NULL").select("_m_odd"), "odd")
    is_odd = F.col(id_col).eqNullSafe(F.col("_m_odd"))
    few = sendable(odd)
    single = docs.join(few, is_odd, "left_anti")
    once = sendable(taken.join(few, F.col("_m_id").eqNullSafe(F.col("_m_odd")), "left_anti").select("_m_id", "_m_copies"))
    rows = single.join(once, F.col(id_col) == F.col("_m_id")).select(*[f"`{c}`" for c in docs.columns], "_m_copies")
    if odd.limit(1).count():
        several = docs.join(few, is_odd, "left_semi").withColumn("_m_own", size.cast("long"))
        order = Window.partitionBy(id_col, source, "_m_own").orderBy(text)
        several = several.withColumn("_m_i", F.row_number().over(order))
        rows = rows.union(several.join(
            taken, F.col(id_col).eqNullSafe(F.col("_m_id")) & F.col(source).eqNullSafe(F.col("_m_source"))
            & (F.col("_m_own") == F.col("_m_size")) & (F.col("_m_i") == F.col("_m_twin")))
            .select(*[f"`{c}`" for c in docs.columns], "_m_copies"))
    return rows.withColumn("_m_pass", F.explode(F.sequence(F.lit(1), F.col("_m_copies")))).drop("_m_pass", "_m_copies")


#: DuckDB SQL for the rows of ``mix`` over documents with the default parameters.
SQL = r"""
WITH d AS (SELECT doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS BIGINT) AS w FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 3 // 2 AS budget,
        CAST(sum(source_size * 2) OVER full_first AS BIGINT) AS filled,
        CAST(sum(w) OVER () - sum(w) OVER full_first AS BIGINT) AS others FROM w
      WINDOW full_first AS (ORDER BY source_size / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, (budget - filled + source_size * 2) * w >= source_size * 2 * (others + w) AS is_full FROM f),
t AS (SELECT *, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE) ELSE
        CAST((budget - CAST(coalesce(sum(CASE WHEN is_full THEN source_size * 2 END) OVER (), 0) AS BIGINT)) * w AS DOUBLE)
        / CAST(sum(CASE WHEN NOT is_full THEN w END) OVER () AS DOUBLE) END AS target FROM o),
q AS (SELECT d.*, t.w, t.source_size, t.budget, t.target,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, pass, (served + pass * source_size) * 10 // w AS finish
      FROM q, (VALUES (0), (1)) AS p(pass) WHERE size > 0),
c AS (SELECT doc_id, source, size,
        CAST(sum(size) OVER (ORDER BY finish, source IS NULL, source, k, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS BIGINT)
          <= budget AS in_mix FROM e),
n AS (SELECT doc_id, count(*) FILTER (in_mix) AS copies FROM c GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target, CAST(coalesce(n.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id
"""
