"""The pipeline's stages on the smallest tables, each against brute force over its own input."""

import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import brute_mix, shingle_set, windows

import corpus_pipeline
from rosterlake.llm.common import saved, table
from rosterlake.llm.quality import score_quality


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def chain(spark, sf):
    """What goes into each stage and what comes out, by stage name."""
    docs, out = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = saved(stage(spark, docs, sf), f"test-{name}")
        out[name] = (docs, kept)
        docs = kept
    return out


def test_stages_keep_columns(spark, sf, chain):
    names = table(spark, sf, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(kept.columns == names for _, kept in list(chain.values())[:-1])


def test_quality_stage(spark, sf, chain):
    docs, kept = chain["quality"]
    labels = table(spark, sf, "labels")
    good = score_quality(docs, labels).filter("predicted = 1")
    assert ids(kept) == ids(good)
    left, marks = set(ids(kept)), {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [i for i in ids(docs) if i in marks and zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum((i in left) == bool(marks[i]) for i in held) >= 0.9 * len(held)


def test_near_duplicate_stage(chain):
    docs, kept = chain["near_duplicates"]
    sets = sorted((r.doc_id, shingle_set(r.text, 5)) for r in docs.collect())
    root = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    assert ids(kept) == sorted(i for i, r in root.items() if i == r)


def test_decontamination_stage(spark, sf, chain):
    docs, kept = chain["decontamination"]
    banned = {g for r in table(spark, sf, "benchmark").collect() for g in windows(r.text)[1]}
    lengths = {len(g) for g in banned}

    def clean(text):
        words = windows(text)[0]
        return not any(tuple(words[i : i + k]) in banned for k in lengths for i in range(len(words) - k + 1))

    assert ids(kept) == sorted(r.doc_id for r in docs.collect() if clean(r.text))


def test_mixing_stage(chain):
    docs, kept = chain["mixing"]
    rows = {r.doc_id: r for r in docs.collect()}
    sizes, targets = brute_mix([(r.doc_id, r.text, r.source) for r in rows.values()])
    length = {i: len(shingle_set(r.text, 1) and (r.text or "").split()) for i, r in rows.items()}
    taken, copies = dict.fromkeys(sizes, 0), {}
    for r in kept.collect():
        assert r == rows[r.doc_id]
        taken[r.source] += length[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    for source, target in targets.items():
        largest = max(length[i] for i, r in rows.items() if r.source == source)
        assert abs(taken[source] - target) <= largest / 2 + 1e-6


def test_sharding_stage_and_run(spark, sf, chain):
    docs, placed = chain["sharding"]
    rows = placed.collect()
    assert ids(placed) == ids(docs)
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    slots, load = {}, dict.fromkeys(range(16), 0)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r["law"] == "bytes"
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(load.values()) / 16, max(size.values())
    assert all(abs(n - share) <= largest + 0.002 * share for n in load.values())
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "size", "shard", "slot")
    assert sorted(map(tuple, whole.collect())) == sorted((r.doc_id, r["size"], r["shard"], r["slot"]) for r in rows)
    assert placed.filter(F.col("text").isNull()).count() == docs.filter(F.col("text").isNull()).count()
