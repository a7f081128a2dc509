"""A content-addressed store of results that cost much to compute: by the hash of a text, with an end of life."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Memo:
    """Results by text hash under a folder that driver and executors share, a folder for each run.

    Rows are only added. A hash whose rows have all expired is computed again; where several live, as after a job that was
    run twice, the latest counts, so a repeated run does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, value: str, minutes: float) -> None:
        self.spark, self.path, self.minutes = spark, path.rstrip("/"), minutes
        self.schema = StructType.fromDDL(f"text_hash string, {value}, computed_at timestamp")

    @staticmethod
    def hashed(text: Column) -> Column:
        """SHA-256 of a text, null as the empty one."""
        return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)

    def live(self, now: datetime.datetime) -> DataFrame:
        """(text_hash, value): the latest result of each hash that has not expired."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema).drop("computed_at")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/run-*")
        alive = rows.filter(F.col("computed_at") > F.lit(now - datetime.timedelta(minutes=self.minutes)))
        value = [c for c in self.schema.names if c not in ("text_hash", "computed_at")]
        return alive.groupBy("text_hash").agg(*[F.max_by(c, "computed_at").alias(c) for c in value])

    def fill(self, texts: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], now: datetime.datetime) -> int:
        """Compute and store what is missing for the texts; returns how many distinct ones that were.

        compute gets (text_hash, text), a row for each distinct text without a live result, and returns text_hash with the value.
        """
        distinct = texts.select(self.hashed(F.col(text)).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text")).groupBy("text_hash").agg(F.min("text").alias("text"))
        missing = distinct.join(self.live(now).select("text_hash"), "text_hash", "left_anti")
        made = compute(missing).withColumn("computed_at", F.lit(now).cast("timestamp")).select(*self.schema.names)
        part = f"{self.path}/run-{uuid.uuid4().hex}"
        made.write.parquet(part)
        return self.spark.read.schema(self.schema).parquet(part).count()

    def through(self, texts: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], now: datetime.datetime) -> DataFrame:
        """texts with text_hash and the value, each text computed once and only if no live result is stored."""
        self.fill(texts, text, compute, now)
        return texts.withColumn("text_hash", self.hashed(F.col(text))).join(self.live(now), "text_hash")
