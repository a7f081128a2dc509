"""The registered queries op1 to op13 themselves: columns and types, nulls, repeats, clashing columns, empty tables, long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import queries as Q

WANT = {
    "op1_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_chat_tool_links": "conv string, call_id string, turn bigint, name string, status string, position bigint, n_calls bigint, n_results bigint, errors array<string>, json string",
    "op4_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_sharding": "doc_id bigint, text_crc32 bigint, size bigint, shard int, slot bigint, law string, grown_shard int",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_token_counts": "doc_id bigint, file_no int, doc_no bigint, start bigint, n_tokens bigint",
    "op9_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int",
}


def write(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        for other in ("id", "shard", "kept", "_key", "score", "kind", "host", "file_no", "rep"):  # names that operators use inside
            df = df.withColumn(other, F.lit("own"))
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "42"]) for _ in range(n))
    item, long = prose(14), prose(60_000)
    docs = [(i, prose(60), "en", f"s{i % 3}", 1) for i in range(30)]
    docs += [(30, None, None, None, None), (31, "", "en", "s0", 0), (None, prose(8), "en", "s1", 5), (3, docs[3][1], "en", "s0", 1), (3, docs[3][1], "en", "s0", 1), (32, f"x {item} y", "en", "s1", 9)]
    docs += [(40, long, "en", "s2", 1), (41, long.replace("alpha", "ALPHA") + " tail", "en", "s2", 1), (42, "w" * 1_000_000, "en", "s2", 1), (43, "w" * 1_000_000, "en", "s2", 1), (44, "w" * 999_999, "en", "s2", 1), (45, " " * 600_000 + "a", "en", "s2", 1)]
    labels = [(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (4, None, 0)]
    pages = [(i, f"http://h{i % 4}.com/p{i}", f"<html>{i}</html>") for i in range(10)] + [(10, None, None), (11, "x", "p" * 1500), (12, "x", "p" * 1500), (12, "x", "p" * 1500), (None, "y", "")]
    turns = [(c, t, ("user", "assistant")[t % 2], f"t{t}") for c in (1, 2) for t in range(8)] + [(None, 0, "user", None), (1, None, "user", "x"), (1, 0, "system", "s"), (1, 0, "user", "again"), (1, 9, None, "y")]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(20)] + [(20, None, None), (21, [], 0), (22, [0.0] * 8, 0), (23, [None, 1.0], 0), (None, [1.0] * 8, 0)]
    vectors += [(24, vectors[3][1], 1), (24, vectors[3][1], 1)]
    rows = {"documents": docs, "labels": labels, "benchmark": [(1, item), (2, None), (None, "alpha"), (3, "")], "pages": pages, "conversations": turns, "embeddings": vectors}
    return write(spark, tmp_path_factory.mktemp("full"), rows), write(spark, tmp_path_factory.mktemp("empty"), {}), rows


@pytest.mark.parametrize("name", WANT)
def test_query(spark, tables, name):
    full, empty, rows = tables
    got = Q.queries()[name](spark, full)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == WANT[name]
    found = got.collect()
    table = {"1": "pages", "6": "pages", "3": None, "9": "embeddings", "11": None}.get(name[2 : name.index("_")], "documents")
    if table:
        assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in rows[table])
    by = {r[0]: r for r in found}
    docs = {r[0]: r[1] for r in rows["documents"]}
    if name.startswith("op2"):
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    if name.startswith("op4"):
        assert {r.doc_id for r in found if r.contaminated} == {32} and by[32].n_hit == 14 and by[40].n_words == 60_000 and by[42].n_words == 1 and by[30].n_words == 0
    if name.startswith("op5"):
        for shard in {r.shard for r in found}:
            assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
        import zlib

        assert all(r.law == "bytes" and r.grown_shard is None and r.size == len((docs[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in found)
    if name.startswith("op6"):
        assert by[11].record_type == "revisit" and by[11].refers_to == 12 and by[12].record_type == "response" and by[10].payload_bytes == 0
    if name.startswith("op8"):
        assert by[30].n_tokens == by[31].n_tokens == 0 and by[42].n_tokens > 1000 and by[45].n_tokens > 1000
    if name.startswith("op9"):
        assert by[3].n_links == 2 and by[24].component_id == 3 and not by[24].kept and by[22].n_links == 0
    if name.startswith("op10"):
        assert by[40].component_id == by[41].component_id == 40 and by[43].component_id == 42 and by[44].component_id == 44 and by[30].n_shingles == 0
    if name.startswith("op11"):
        assert sorted(str(r.conv_id) for r in found) == ["1", "2", "None"]
    if name.startswith("op12"):
        assert by[30].n_runs == by[42].n_runs == 0
    if name.startswith("op13"):
        assert by[30].n_tokens == 0 and by[42].n_tokens > 1000 and all(r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest() for r in found)
    assert Q.queries()[name](spark, empty).collect() == []


def test_every_oracle_names_a_query():
    assert set(Q.oracle_sql()) <= set(Q.queries()) == set(WANT)


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    import corpus_pipeline

    full, empty, rows = tables
    out = corpus_pipeline.run(spark, full)
    kept = out.collect()
    assert set(SCHEMAS["documents"].replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
    assert {r["doc_id"] for r in kept} <= {r[0] for r in rows["documents"]} and 32 not in {r["doc_id"] for r in kept}
    assert corpus_pipeline.run(spark, empty).collect() == []
