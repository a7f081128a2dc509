"""Readers and writers: tables, point and paged reads, the landing zone, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """The row with this key; the filter reaches the Parquet scan."""
    return df.filter(F.col(column) == value).limit(1)


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100, **equal) -> DataFrame:
    """One page of a table in a fixed order; a filter whose value is None does not apply."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(*order).offset(skip).limit(limit)


def pack_files(files: DataFrame, path: str) -> None:
    """Write files (path, content), a row each, into packs: Parquet with the columns path, length and content of the binaryFile source.

    Millions of small files cost a listing, an opening and a renaming each; packs grow with the bytes alone.
    """
    files.select("path", F.octet_length("content").cast("long").alias("length"), "content").write.parquet(path)


def landing_zone(spark: SparkSession, path: str, *, kinds: tuple[str, ...] = ("txt", "json"), largest: int = 10 << 20, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder and those below it, each by its path, as names may repeat; with packed, those in the packs of a folder.

    Rejected are other kinds, whatever the case of their ending, and files above the size cap; the content of neither is read.
    Accepted ones come with their text and status pending. An empty folder gives no rows.
    """
    def named(files: DataFrame, *more: str) -> DataFrame:
        kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type")
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), kind, *more)

    if packed:
        every = spark.read.schema("path string, length long, content binary").parquet(path)
        read = lambda pathGlobFilter="*": every if pathGlobFilter == "*" else every.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds))
    else:
        read = lambda **options: spark.read.format("binaryFile").load(path, recursiveFileLookup=True, **options)
    ending = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in kind) for kind in kinds)
    fit = named(read(pathGlobFilter=f"*.{{{ending}}}"), "content").filter(F.col("file_size") <= largest)
    good = fit.select("path", "file_name", "file_size", "file_type", F.decode("content", "UTF-8").alias("raw_text"), F.lit("pending").alias("processing_status"))
    reason = F.when(~F.col("file_type").isin(*kinds), "kind").when(F.col("file_size") > largest, "too large")
    return good, named(read()).withColumn("reason", reason).filter("reason IS NOT NULL")
