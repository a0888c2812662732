"""Structured Streaming twins of the hourly roll-up and the anomaly flags.

Both read the events table as a file stream, use an event-time watermark on a
zoned ``timestamp`` (the watermark rejects ``timestamp_ntz``) and cast back to
``timestamp_ntz`` on output. Sink and checkpoint are arguments: a run that is given
the paths of an earlier one goes on after that one's last committed batch, and reads
only the files that are new. Without them each call starts afresh below the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, scratch_path

WATERMARK = "2 hours"


def _event_stream(spark: SparkSession, events_path: str, max_files: int | None = None) -> DataFrame:
    """File stream over a folder of event files, or over a single table file; ``max_files``
    bounds a micro-batch (all new files by default)."""
    schema = spark.read.parquet(events_path).schema
    pattern = events_path
    if events_path.endswith(".parquet"):
        # a file source watches a folder; the glob keeps it to the one table file
        folder, name = events_path.rsplit("/", 1)
        pattern = f"{folder}/{name[0]}[{name[1]}]{name[2:]}"
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_demand_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Watermark, one-hour tumbling windows per type, exact decimal sums."""
    return (events.withWatermark("ts", watermark)
                  .groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("city"))
                  .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("demand")))


def run_hourly_demand(spark: SparkSession, events_path: str, sink_path: str | None = None,
                      checkpoint_path: str | None = None, max_files: int | None = None) -> DataFrame:
    """Run X1 to completion (availableNow) and return the final table.

    The stream runs in update mode; each micro-batch writes its updated windows
    to a folder of its own, named by the batch id, and the final value per window
    is the one from the latest batch. A batch that runs again after a failure
    overwrites its folder, so the result is unchanged (idempotent).
    """
    out = sink_path or scratch_path(spark, "x1_sink")
    ckpt = checkpoint_path or scratch_path(spark, "x1_ckpt")
    agg = hourly_demand_stream(_event_stream(spark, f"{events_path}", max_files))

    def sink(batch: DataFrame, batch_id: int):
        (batch.select("city", F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "demand")
              .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    latest = res.groupBy("city", "timestamp").agg(F.max_by("demand", "batch_id").alias("demand"))
    return latest.select("city", "timestamp", F.col("demand").cast("double").alias("demand"))


def flag_stream(events: DataFrame, stats: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Stream-static join with a frozen per-type statistics table."""
    j = events.join(stats, "event_type", "left")
    z = F.abs(F.try_divide(F.col("value") - F.col("mu"), F.col("sd")))
    return j.select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value",
                    F.coalesce(z > threshold, F.lit(False)).alias("anomaly_z"))


def run_flag_stream(spark: SparkSession, events_path: str, sink_path: str | None = None,
                    checkpoint_path: str | None = None, stats_path: str | None = None) -> DataFrame:
    """Run X2 to completion. Statistics are frozen at the first run: a resumed run that is
    given the same ``stats_path`` reads them instead of taking them anew."""
    static = spark.read.parquet(events_path)
    stats = static.groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    frozen_path = stats_path or scratch_path(spark, "x2_stats")
    if not path_exists(spark, frozen_path):
        stats.write.parquet(frozen_path)                # frozen statistics table
    frozen = spark.read.parquet(frozen_path)
    out = sink_path or scratch_path(spark, "x2_sink")
    ckpt = checkpoint_path or scratch_path(spark, "x2_ckpt")
    flagged = flag_stream(_event_stream(spark, events_path), frozen)
    q = (flagged.writeStream.outputMode("append").format("parquet").option("path", out)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(flagged.schema).parquet(out)
