"""Continuous audit of a folder, and hit rates over time. Extensions: the batch operators' columns, run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import routing
from glyphsieve.operators import audit


def landing(spark: SparkSession, root: str) -> DataFrame:
    """New files below ``root`` as a stream of text audit items; files of other kinds are unknown items without findings."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(root)
    reason = routing.binary_reason(F.col("content"))
    texts = audit.text_items(files.withColumn("text", F.when(reason.isNull(), F.make_valid_utf8(F.col("content").cast("string")))).withColumn("foreign", reason.isNotNull()), F.struct("path", "foreign"))
    named = texts.withColumn("kind", F.when(F.col("path.foreign"), "unknown").otherwise(F.col("kind"))).withColumn("path", F.col("path.path"))
    return audit.with_actionable(named)


def rates(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)`` per window of ``(ts, event_type, value)``; on a stream late rows wait for ``late``."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    out = kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles what is there, writes Parquet, and ends."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
