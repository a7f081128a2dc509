"""Snapshots: null-skipping upserts, versions, deletes, merges and deduplication of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_patch(patch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One patch row a key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return patch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(base: DataFrame, patch: DataFrame, keys: list[str], replace: tuple[str, ...] = ()) -> DataFrame:
    """base with patch applied: unknown keys inserted, known ones changed where the patch is not null (always for replace).

    patch holds one row a key. Applying a patch twice is the same as once.
    """
    values = [c for c in base.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = base.withColumn("_had", F.lit(True)).join(p, keys, "full")
    pick = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in replace else F.coalesce(f"_new_{c}", c).alias(c) for c in values]
    return joined.select(*keys, *pick)


def number_versions(new: DataFrame, old: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """new rows numbered after the highest version stored for their key."""
    top = old.groupBy(key).agg(F.max(version).alias("_top"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(top, key, "left").withColumn(version, (F.coalesce("_top", F.lit(0)) + turn).cast("int")).drop("_top")


def flag_current(versions: DataFrame, key: str, version: str) -> DataFrame:
    """is_current on each key's highest version only."""
    return versions.withColumn("is_current", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))) == 1)


def append_versions(old: DataFrame, new: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """old and new rows together, the new ones numbered on, is_current on each key's last. Nothing stored has to change but this flag."""
    numbered = number_versions(new, old, key, version, order)
    return flag_current(old.unionByName(numbered), key, version)


def soft_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    marks = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(marks, key, "left").withColumn("is_archived", F.coalesce("_gone", F.lit(False))).withColumn("is_active", F.col("_gone").isNull()).drop("_gone")


def cascade(parents: DataFrame, parent_key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Children without the rows of the parents given."""
    return [child.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti") for child, key in children]


def dedup_entries(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first entry of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return entries.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_entries(entries: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """One row a key; of each value the first that is not null, by order."""
    first = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return entries.groupBy(*keys).agg(*first)


def merge_parses(first: DataFrame, second: DataFrame, key: str, united: str, entries: str) -> DataFrame:
    """(key, united, entries): lists of two parses united and sorted; the second's count of entries only where the first has none."""
    none = F.array().cast("array<string>")
    a = first.select(key, F.col(united).alias("_u1"), F.col(entries).alias("_e1"))
    b = second.select(key, F.col(united).alias("_u2"), F.col(entries).alias("_e2"))
    both = F.array_sort(F.array_union(F.coalesce("_u1", none), F.coalesce("_u2", none)))
    kept = F.when(F.coalesce("_e1", F.lit(0)) == 0, F.col("_e2")).otherwise(F.col("_e1"))
    return a.join(b, key, "full").select(key, both.alias(united), kept.cast("long").alias(entries))


def fold_terms(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """Terms of a document that contain no other term of it: of a term and a longer form the shorter stays. Order does not matter."""
    every = terms.select(F.col(doc).alias("_d"), F.col(term).alias("_t")).distinct()
    a, b = every.alias("a"), every.alias("b")
    inside = (F.col("a._d") == F.col("b._d")) & F.contains(F.lower("a._t"), F.lower("b._t")) & (F.lower("a._t") != F.lower("b._t"))
    return a.join(b, inside, "left_anti").select(F.col("_d").alias(doc), F.col("_t").alias(term))


def once_per_text(df: DataFrame, text: str, compute) -> DataFrame:
    """df with the columns that compute adds to a table of distinct texts (text_hash, text), each text computed once."""
    keyed = df.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    distinct = keyed.groupBy("text_hash").agg(F.min(text).alias(text))
    return keyed.join(compute(distinct).drop(text), "text_hash")
