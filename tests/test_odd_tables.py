"""Registered queries on empty tables, and on tables with nulls, repeated rows, long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = ["pair_percentiles", "missing_skills", "status_transitions", "ingested_versions", "text_embeddings", "suppress_forward", "document_validity", "nearest_vectors", "resume_records"]
KEYS = {"documents": "doc_id", "events": "event_id", "conversations": "conv_id", "embeddings": "vec_id", "orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "nation": "n_nationkey"}


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    folder, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name, key in KEYS.items():
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        few = df.filter(F.col(key) < 40)
        nulls = few.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        long = few.filter(F.col(key) == 7).limit(1).select(*[F.repeat(F.lit("long text | with words\n"), 20_000).alias(c) if c == "text" else F.col(c) for c, _ in df.dtypes])
        rows = few.unionByName(nulls).unionByName(nulls).unionByName(few.limit(3)).unionByName(long)
        for other in ("_flag", "score", "state", "_side", "text_hash"):  # names that operators use inside
            if other not in rows.columns:
                rows = rows.withColumn(other, F.lit("own"))
        rows.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(folder), str(empty)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_odd_and_empty_tables(spark, odd, name):
    full, empty = odd
    got = entry.queries()[name](spark, full)
    assert got.count() > 0 and not any(c.startswith("_") for c in got.columns)
    none = entry.queries()[name](spark, empty)
    assert none.schema.names == got.schema.names and none.collect() == []
