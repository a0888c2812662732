"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly, by a seeded hash, into buckets that fit in
memory. Pass two takes one bucket at a time, puts it into a fixed order, permutes it by
Fisher-Yates with a generator seeded for the bucket, and writes it. The buckets one after
the other are the shuffled table; shard ``s`` of ``n`` gets places ``s*N/n`` to
``(s+1)*N/n`` of it, so shard sizes differ by one row at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import running_offsets, saved, sendable

SHARDS = 8
SEED = 20
BUCKET_BYTES = 16 << 20


def _shuffled(seed: int):
    """Permutes one bucket: sorted rows, then a seeded Fisher-Yates permutation of them."""
    def one(part: pa.Table) -> pa.Table:
        n = part.num_rows
        rows = np.asarray(part.column("_key"))
        tie = np.asarray(part.column("_tie"))
        order = np.lexsort((tie, rows))
        swap = np.random.default_rng([seed, int(part.column("_bucket")[0].as_py())]).permutation(n)  # Fisher-Yates
        out = part.take(pa.array(order[swap]))
        return out.append_column("_at", pa.array(np.arange(n, dtype=np.int64)))
    return one


def shard(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS,
          seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all of ``docs``, shuffled, below ``path`` as ``shard=0..n-1`` and reads them back.

    The result has the columns of ``docs`` (renamed ``<name>_in`` where they would clash
    with shard or slot) and ``shard`` (int), ``slot`` (long, 0.. without gaps in each
    shard, the order in which the shard is to be read).

    * The bucket of a row comes from its id and its text together, so one id (or NULL) with
      many texts spreads, and so does one text with many ids. Only rows that are equal in
      both share a bucket; which of them comes first makes no difference to what is written.
    * NULL and empty texts count one byte. A row longer than a bucket fills it alone.
    * An empty table gives empty shards (no files) and an empty result.
    * Groups: equal texts are not kept together; their ids scatter them.
    """
    spark = docs.sparkSession
    # the record travels as one struct: its columns cannot clash with working columns
    d = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"{c}_in" if c.lower() in ("shard", "slot") else c)
                               for c in docs.columns]).alias("_row"))
    row = lambda c: F.col("_row").getField(c)
    size = F.coalesce(F.octet_length(row(text)), F.lit(0)).cast("long") + 1
    total, rows = d.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    own = F.xxhash64(F.lit(seed), row(id_col), row(text))
    scattered = d.select("_row", own.alias("_key"), F.xxhash64(row(text)).alias("_tie"),
                         F.pmod(own, F.lit(buckets)).alias("_bucket"))
    schema = scattered.schema.add("_at", "long")
    # the counts need two narrow columns, not the texts
    counts = (d.select(F.pmod(own, F.lit(buckets)).alias("_bucket")).groupBy("_bucket")
              .agg(F.count(F.lit(1)).alias("_n")))
    # two numbers a bucket: the shuffled texts stay where they are
    bases = sendable(saved(running_offsets(counts, "_bucket", "_n", "_base").select("_bucket", "_base"), "bases"))
    placed = (scattered.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(_shuffled(seed), schema)
              .join(bases, "_bucket").withColumn("_place", F.col("_base") + F.col("_at")))
    n = max(1, rows)
    which = F.floor(F.col("_place") * F.lit(shards) / F.lit(n)).cast("int")
    first = F.ceil(F.col("_shard") * F.lit(n) / F.lit(shards)).cast("long")
    out = placed.withColumn("_shard", which).select(
        "_row.*", (F.col("_place") - first).alias("slot"), F.col("_shard").alias("shard"))
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def shard_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What the contract asks of :func:`shard`, read from the written shards."""
    out = shard(docs, path or scratch_path(docs.sparkSession, "shards"))
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
                      F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
