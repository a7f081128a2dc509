"""Streams: ingest by micro-batch, status per document, attempts, duplicates, windows; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Run apply(batch, batch_id) on every micro-batch to the end of what there is. apply must give the same for the same id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_latest(events: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """Last status of each key; works on streams (complete or update mode) and tables."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(ts, "event_id")).alias(status), F.max(ts).alias(ts))


def attempts(events: DataFrame, key: str, failed, limit: int) -> DataFrame:
    """(key, failures, route): dead_letter at the limit of failures, retry below it."""
    n = events.filter(failed).groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    return n.withColumn("route", F.when(F.col("failures") >= limit, "dead_letter").otherwise("retry"))


def drop_repeats(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's reach."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def drop_repeats_of_table(events: DataFrame, key: str, ts: str) -> DataFrame:
    """drop_repeats for a table: each key once, at its first time."""
    return events.groupBy(key).agg(F.min(ts).alias(ts))


def unexpired(entries: DataFrame, ts: str, minutes: Column, now) -> DataFrame:
    """entries with expires_at, those that live beyond now; minutes is how long each lives."""
    until = F.col(ts) + F.make_dt_interval(mins=minutes.cast("int"))
    return entries.withColumn("expires_at", until).filter(F.col("expires_at") > F.lit(now)).drop(ts)


def progress(events: DataFrame, ts: str, status: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count by window and status."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(window.alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), status, "n")


def rate_violations(events: DataFrame, user: str, ts: str, size: str, limit: int) -> DataFrame:
    """Users with more than limit events in a tumbling window."""
    counted = events.groupBy(F.window(ts, size).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit).select(user, F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), "n")
