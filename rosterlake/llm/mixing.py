"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, a cut at each budget.

Targets come from the sources' sizes alone: each source gets its weight's share of all words, none more than max_epochs
times what it holds, and what it cannot take goes to the others by weight. Within a source the documents have a random but
repeatable order, the hash of their ids; a range sort over the cluster and prefix sums of the sizes say how many words
stand before each document, and so how often the mix takes it: once for every whole epoch, once more before the cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, running_totals, saved

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(key: Column, seed: int = SEED) -> Column:
    """Random order that any engine with md5 reproduces."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, source: str, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row a source.

    Sources in code point order, null last, weigh the given weights in turn. With the sources in rising order of the
    multiple at which each would be full, all that come before some place are full and the rest share what is left by
    weight; the place is the first where the next one is not full.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = reduce(lambda c, i: F.when(turn == i, F.lit(float(weights[i]))).otherwise(c), range(len(weights)), F.lit(None).cast("double"))
    base = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    past, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))) / F.sum("_w").over(rest)
    at = base.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    final = at.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)["_level"])
    target = F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap"))
    return final.select(F.col(source), "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    carry: str | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for every row of docs; with carry, that column as carried.

    Documents are taken whole: the one that the cut falls into is taken when at least half of it lies before the cut, so a
    source misses its target by at most half a document. A null or empty text has size 0 and is taken with the epochs it
    falls into at no cost. Rows that share an id are ordered by size; fully repeated rows are interchangeable. A source of
    size 0 has target 0. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    extra = [F.col(carry).alias("carried")] if carry else []
    slim = saved(docs.select(F.col(key).alias("_k"), F.col(source).cast("string").alias("_g"), word_count(F.col(text)).alias("_n"), mix_key(F.col(key), seed).alias("_h"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_t"), *extra), "mix-sizes")
    sizes = slim.groupBy("_g").agg(F.sum("_n").alias("source_size"))
    targets = saved(source_targets(sizes, "_g", weights, max_epochs), "mix-targets").withColumnRenamed("_g", "_s")
    placed = running_totals(slim.withColumnRenamed("_g", "_group"), "_group", ["_h", "_t", "_n"], "_n", "mix-order")
    both = placed.join(targets, F.col("_group").eqNullSafe(F.col("_s")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    copies = (epochs + F.when(F.col("before") + F.col("_n") / F.lit(2.0) <= rest, 1).otherwise(0)).cast("long")
    copies = F.least(copies, F.lit(int(max_epochs)).cast("long"))
    out = both.select(F.col("_k").alias(key), F.col("_group").alias(source), F.col("_n").alias("size"), "source_size", "target", copies.alias("copies"), *(["carried"] if carry else []))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, rows with none left out. Columns as in docs."""
    names = docs.columns
    row, copies = fresh("_row", names), fresh("_copies", names)
    # Rows get a number to be found again by, whatever ids they share; it has no part in their order.
    named = saved(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_sources(named, key=key, text=text, source=source, carry=row, **options)
    picked = plan.filter("copies > 0").select(F.col("carried").alias(row), F.col("copies").alias(copies))
    return named.join(picked, row).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*names)
