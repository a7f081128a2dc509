"""Shared pieces: table access, work tables in the cluster's shared folder, running totals over a range sort."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII capitals and their small letters, for folding that leaves other scripts alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session may go without one and gets its own; a cluster may not."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rosterlake.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
        spark.conf.set("rosterlake.work.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/rosterlake/{label}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow batches of whole texts hold at most so many rows, so that tasks need little memory beside the JVM's.

    The setting is the session's own, read when a plan runs and so not restored here; it is only ever made smaller. Spark's
    spark.sql.execution.arrow.maxBytesPerBatch bounds the bytes of a batch besides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def saved(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet work table in the shared folder and read it back: cuts lineage and survives lost executors.

    With by, a folder for each value of that column; a filter on it reads that folder alone.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a work table that no later plan reads."""
    path = getattr(df, "work_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken (Spark compares without regard to case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, *, how: str = "inner", least: int = 256, most: int = 10_000) -> DataFrame:
    """rows joined with groups (one row a key, count telling how many rows bear it) without one task for a key of very many rows.

    Groups of more than total / most rows, and of more than least, are sent to the rows; of these there are at most most.
    The others meet their rows in a shuffled join. total is the number of rows. how is inner or left; count is dropped.
    """
    limit = max(least, total // most)
    mark = fresh("_hot", [*rows.columns, *groups.columns])
    hot = groups.filter(F.col(count) > limit).drop(count)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias(mark))), keys, "left").filter(F.col(mark).isNull()).drop(mark)
    cold = rest.join(groups.filter(F.col(count) <= limit).drop(count), keys, how)
    return met.unionByName(cold)


def fold_ascii(column):
    return F.translate(column, UPPER, LOWER)


def running_totals(df: DataFrame, group: str, order: list[str], amount: str, label: str, *, split: list | None = None, count: str | None = None) -> DataFrame:
    """Add before (sum of amount over the group's earlier rows) and rank (from 0) in the order given.

    split, columns that agree with the order, deals the rows to tasks in its place: for an order that ends in long texts, whose
    beginnings are enough. count names a column for the group's number of rows.

    The rows are range-sorted over the cluster on (group, order), so that a group holding most rows spreads over many
    tasks; each task adds up its own rows, and the few totals per task and group are prefix-summed and joined back.
    group, order and amount may not be null, except group, where null is a group of its own.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(group).asc_nulls_last(), *[F.col(c).asc() for c in order]]
    deal = [key[0], *split] if split else key
    ordered = df.repartitionByRange(n, *deal).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("_in", T.LongType()), T.StructField("_at", T.LongType())])
    arrow_in, arrow_at = pa.field("_in", pa.int64()), pa.field("_at", pa.int64())

    def add_up(batches):
        last, total, count = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False), dtype=np.int64)
            names = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            codes = np.asarray(names.indices.fill_null(-1).to_numpy(zero_copy_only=False))
            words = names.dictionary.to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            before, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for a, b in zip(starts, [*starts[1:], len(size)]):
                word = words[codes[a]] if codes[a] >= 0 else None
                if word != last:
                    last, total, count = word, 0, 0
                sums = np.cumsum(size[a:b])
                before[a:b] = total + sums - size[a:b]
                at[a:b] = count + np.arange(b - a)
                total, count = total + int(sums[-1]), count + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(at)], schema=pa.schema([*batch.schema, arrow_in, arrow_at]))

    parts = saved(ordered.mapInArrow(add_up, schema), label)
    # One row per task and group: the only thing that goes through a window.
    ends = parts.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum(amount).alias("_s"), F.count(F.lit(1)).alias("_c"))
    from pyspark.sql import Window

    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_c").over(Window.partitionBy("_g")).alias(count)] if count else []
    ends = ends.select("_g", "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"), *whole)
    joined = parts.join(ends, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn("before", F.col("_in") + F.col("_s0")).withColumn("rank", F.col("_at") + F.col("_c0")).drop("_part", "_in", "_at", "_g", "_p", "_s0", "_c0")
