"""Scans over streams of files and of events."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import Config, scan


def changed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files as they appear or change: path, content, mtime."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


def watch(files: DataFrame, rules: list[dict[str, Any]], sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config = Config(), every: str | None = None):
    """Scan each batch's latest version of each file and give its findings to `sink`; the trigger's interval debounces."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("path").agg(F.max_by("content", "mtime").alias("content"))
        sink(scan(latest, rules, config).findings, number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_versions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The latest text of each document from a stream or table of changes (uri, ts, text); closed documents have none."""
    latest = F.max_by(F.struct("text", "ts"), "ts")
    return events.withWatermark("ts", late).groupBy("uri").agg(latest.alias("v")).select("uri", "v.text", "v.ts").where("text IS NOT NULL")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events in tumbling or sliding windows of time: start, event_type, n, total."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def joined(events: DataFrame, first: str, second: str, within: str, late: str) -> DataFrame:
    """Events of type `second` with those of type `first` that the same user had up to `within` before: user_id, first_id, second_id.

    Both sides of a stream keep only rows that a partner may still come for: a row is let go once the watermarks of both have passed
    what it can meet. Rows behind the watermark meet nothing; the stream's progress counts them. Null users meet nobody.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    a = rows.where(F.col("event_type") == first).select(F.col("user_id").alias("_user"), F.col("event_id").alias("first_id"), F.col("ts").alias("_at")).withWatermark("_at", late)
    b = rows.where(F.col("event_type") == second).select("user_id", F.col("event_id").alias("second_id"), "ts").withWatermark("ts", late)
    near = F.expr(f"user_id = _user AND ts >= _at AND ts <= _at + INTERVAL {within}")
    return a.join(b, near).select("user_id", "first_id", "second_id")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap: user_id, start, end, n."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
