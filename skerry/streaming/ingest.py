"""Feed ingestion as Structured Streaming.

The engine's offset log and checkpoint take the place of the hand-kept watermark;
what the log can't know, gaps and slices that never came, is kept in the slice
table and read by ``watermark.contiguous``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.plans.keyed import KeyedTable

MISSING_AFTER = 3 * 3600


def slice_status(published: Column, failed: Column, rows: Column, age_seconds: Column) -> Column:
    """pending, ok, empty, missing or failed; what isn't published after three hours is missing (ST04)."""
    return (
        F.when(failed, "failed")
        .when(published & (rows > 0), "ok")
        .when(published, "empty")
        .when(age_seconds >= MISSING_AFTER, "missing")
        .otherwise("pending")
    )


def catch_up(slots: DataFrame, watermark: DataFrame, bound: int = 32) -> DataFrame:
    """The next slots of each feed to process, in order, up to the first that isn't there yet (ST02).

    ``slots``: feed, slot, status.
    """
    from pyspark.sql import Window

    ahead = slots.join(watermark, "feed").where("slot > watermark")
    order = Window.partitionBy("feed").orderBy("slot")
    stop = F.max(F.when(F.col("status") == "pending", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ahead.withColumn("_n", F.row_number().over(order)).withColumn("_stop", stop).where((F.col("_n") <= bound) & (F.col("_stop") == 0)).select("feed", "slot", "status")


def append_once(batch: DataFrame, path: str, key: list[str], name: str) -> int:
    """Add the rows whose key isn't in the keyed table (ST05); a batch of a name that was added adds nothing."""
    return KeyedTable(batch.sparkSession, path, key).insert(batch, name)


def ingest(source: DataFrame, path: str, checkpoint: str, key: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Drain a stream into a keyed table (see ``KeyedTable.read``), idempotently, one micro-batch after the other.

    A batch's name is made of the checkpoint and its number, so one that is replayed after a crash is added once.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        append_once(prepare(batch) if prepare else batch, path, key, f"{stream}-{number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slice_counts(events: DataFrame, by: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Events in each quarter hour; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", "15 minutes").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("slice_start"), by, "n")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: counts over sliding windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """An extension: sessions that end after a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), "n")


def stream(spark: SparkSession, path: str, schema, per_trigger: int = 32) -> DataFrame:
    """Parquet files as a stream, at most ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def land(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to a partition of its own, once: a replayed batch takes the place of what it wrote before.

    What a source read from elsewhere is read once this way, whatever is made of it later.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
