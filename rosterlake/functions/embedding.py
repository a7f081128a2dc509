"""Embeddings of texts without a model: signed feature hashing of words, in built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_vectors(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, vector): unit vectors of dims components for texts with distinct keys.

    Each lower-case word (split at white space) adds 1 or -1 to one component, both by its MD5; a text without words, or whose
    words cancel out, gets the zero vector. Words are counted by key, component and sign before they move, so neither a long
    text nor a common word stands in one task as single words.
    """
    words = texts.select(key, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+")).alias("w")).filter("w <> ''")
    digest = F.md5(F.col("w").cast("binary"))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("int")
    parts = words.select(key, (number(1, 4) % dims).alias("i"), F.when(number(5, 1) % 2 == 0, 1).otherwise(-1).alias("s")).groupBy(key, "i").agg(F.sum("s").alias("s"))
    sums = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")).alias("n"))
    component = lambda i: F.when(F.col("n") > 0, F.coalesce(F.col("m")[i], F.lit(0)) / F.col("n")).otherwise(0.0)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), component)
    zero = F.array_repeat(F.lit(0.0), dims)
    return texts.select(key).join(sums, key, "left").select(key, F.coalesce(vector, zero).alias("vector"))
