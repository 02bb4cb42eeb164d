"""Streams of documents: the batch readers and operators on structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import engine
from leafmill.operators import nodes as N


def arriving(spark: SparkSession, folder: str, suffix: str = "*", binary: bool = False) -> DataFrame:
    """path, time, content of files as they arrive in a folder."""
    if binary:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*.{suffix}").load(folder)
        return rows.select("path", F.col("modificationTime").alias("time"), "content")
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time"), F.col("value").alias("content"))


def nodes(rows: DataFrame, format: str) -> DataFrame:
    """Nodes of arriving documents; a document's id is a hash of its path."""
    return engine.read_nodes(rows.withColumn("doc_id", F.xxhash64("path")), format, "doc_id", "content")


def link_counts(rows: DataFrame, format: str) -> DataFrame:
    """Links per address so far: an update per batch."""
    return N.link_counts(nodes(rows, format))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events per type and window; those later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def once(rows: DataFrame, keys: list[str], time: str = "time", late: str = "1 day") -> DataFrame:
    """Each key once while the watermark lasts."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, batch by batch into sink; the checkpoint makes each input count once."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
