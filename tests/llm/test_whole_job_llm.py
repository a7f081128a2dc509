"""Links at the threshold, ids that repeat, and short texts, held against whole tables."""

import inspect

import numpy as np
import pytest

from rosterlake.llm import minhash, vector_dedup

# --- op9 ----------------------------------------------------------------------------------------------------------


def planted(rng, n, dim, low, high):
    """n pairs of unit vectors with cosines from low to high."""
    a, b = (vector_dedup.unit(rng.normal(size=(n, dim))) for _ in range(2))
    b = vector_dedup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(low, high, size=(n, 1))
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("n, dim", [(500, 64), (5000, 64), (100000, 64), (5000, 16)])
def test_bands_miss_no_planted_pair(n, dim):
    miss = inspect.signature(vector_dedup.similar_vectors).parameters["miss"].default
    plan = vector_dedup.plan_for(n, 0.9, miss)
    a, b = planted(np.random.default_rng(n), 20000, dim, 0.9, 0.9)
    met, n_met = 0, 0.0
    for c in range(0, len(a), 2000):
        same = vector_dedup.band_keys(a[c : c + 2000], plan) == vector_dedup.band_keys(b[c : c + 2000], plan)
        met, n_met = met + int(same.any(axis=1).sum()), n_met + same.sum()
    assert met == len(a)
    assert abs(n_met / len(a) / plan.bands / (1 - np.arccos(0.9) / np.pi) ** plan.bits - 1) < 0.03


def test_planted_vectors_all_link(spark):
    a, b = planted(np.random.default_rng(3), 4000, 64, 0.9, 0.905)
    near = np.einsum("ij,ij->i", a, b) >= 0.9
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r for r in vector_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert near.sum() > 3900 and all(got[i].n_links >= 1 and got[i + 4000].component_id == got[i].component_id for i in np.flatnonzero(near))


# --- pipeline: near_duplicates ------------------------------------------------------------------------------------


def test_near_duplicate_stage_keeps_clean_texts_that_share_an_id(spark, sf):
    import corpus_pipeline

    a, b, c = ("%s alpha beta gamma delta epsilon zeta eta theta" % w for w in ("one two three four five", "red blue green white black", "cat dog cow pig hen"))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (0, c), (4, None), (4, None), (4, ""), (5, ""), (None, a)]
    docs = spark.createDataFrame([(i, " ".join(w + x for x in "xyz" for w in t.split()) if t else t) for i, t in rows], "doc_id long, text string")
    full = {t: " ".join(w + x for x in "xyz" for w in t.split()) for t in (a, b, c)}
    for n in (1, 4):
        left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(n), sf).collect()]
        assert sorted((str(i), t or "") for i, t in left) == sorted([("1", full[a]), ("1", full[b]), ("0", full[c]), ("4", ""), ("5", ""), ("None", full[a])])


# --- op10 ---------------------------------------------------------------------------------------------------------


def test_short_texts_pass_the_estimate(spark):
    rng = np.random.default_rng(8)
    words = [[f"{i}w{j}{rng.integers(1 << 30)}" for j in range(6)] for i in range(12000)]
    sets = lambda texts: [next(minhash.W.shingles(h, first, 1)) for _, _, h, first in (minhash.W.scan(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), minhash.W.BLANKS) for t in texts)]
    short, long = [" ".join(w[:4]) for w in words], [" ".join(w[:5]) for w in words]  # similarity 0.8
    low = np.flatnonzero(minhash.estimate(minhash.registers(sets(short)), minhash.registers(sets(long))) < 0.68)
    assert len(low)
    rows = [(2 * int(i) + s, t[int(i)]) for i in low for s, t in enumerate((short, long))]
    docs = spark.createDataFrame(rows, "id long, text string")
    pairs = spark.createDataFrame([(2 * int(i), 2 * int(i) + 1) for i in low], "a long, b long")
    texts = docs.join(minhash._sketch(docs, 1).select("id", "n", "regs"), "id")
    assert minhash._verify(pairs, texts, 1, 80, 0.12).count() == len(low)
