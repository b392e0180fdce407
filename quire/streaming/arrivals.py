"""Documents and calls that arrive over time: Structured Streaming twins of batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fresh_documents(docs: DataFrame, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Drops replays of equal content within the watermark."""
    d = docs.withWatermark(ts, late).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return d.dropDuplicatesWithinWatermark(["content_hash"]) if docs.isStreaming else d.dropDuplicates(["content_hash"])


def call_windows(calls: DataFrame, by: str = "event_type", ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, by, calls, failures, total: tumbling windows; batch and stream alike."""
    w = calls.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by)
    a = w.agg(F.count("*").alias("calls"), F.count_if(F.col(by) == "error").alias("failures"), F.sum("value").alias("total"))
    return a.select(F.col("w.start").alias("window_start"), by, "calls", "failures", "total")


def run_stream(source: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's plan to a Parquet table; a repeated batch overwrites its own partition."""

    def put(batch: DataFrame, batch_id: int) -> None:
        plan(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
