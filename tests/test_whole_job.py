import difflib
import re

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import columns as C
from rosterlake.functions import lexicons as L
from rosterlake.operators import lexicon, meet, ranking
from rosterlake.operators import skills as skills_of


def profiles(spark, skills, asked, projects=(), a=(), b=(), years=()):
    """(candidates, jobs) of small tables."""
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    own, wanted = made(skills, "candidate_id long, skill string"), made(asked, "job_id long, skill string, rn int, kind string")
    met = ranking.met_skills(own, wanted, skills_of.alias_table(spark))
    left = ranking.candidate_profiles(own, met, made(years, "candidate_id long, have long"), made(projects, "candidate_id long, project long, text string"), wanted, made(a, "candidate_id long, vector array<double>"))
    return left, ranking.job_profiles(wanted, made([(j, 0) for j in {r[0] for r in asked}], "job_id long, years int"), made(b, "job_id long, vector array<double>"))


def test_best_job_is_over_all_pairs(spark):
    overall = {(1, 1): 50.0, (1, 2): 55.0, (1, 3): 54.0, (2, 1): 30.0, (3, 1): 20.0, (3, 2): 70.0, (4, 2): 40.0, (4, 1): 40.0}
    stored = spark.createDataFrame([(c, j, overall.get((c, j), 0.0)) if (c, j) != (3, 2) else (3, 2, 10.0) for c in (1, 2, 3, 4) for j in (1, 2, 3)], "candidate_id long, job_id long, overall double")
    left, right = profiles(spark, [(c, "sql") for c in (1, 2, 3, 4)], [(j, "sql", 1, "required") for j in (1, 2, 3)])
    assert sorted(map(tuple, ranking.best_with_stored(left, right, stored).collect())) == [(1, 2, 55.0), (2, 1, 30.0), (3, 1, 20.0), (4, 1, 40.0)]


def test_best_job_query_misses_no_pair(spark, sf):
    from rosterlake import catalogue

    best = {}
    for r in catalogue._ranked(spark, sf).select("candidate_id", "job_id", "overall").collect():
        best[r.candidate_id] = max(best.get(r.candidate_id, (-1.0, 0)), (r.overall, -r.job_id))
    got = {r.candidate_id: (r.best_score, -r.job_id) for r in catalogue.best_job_per_candidate(spark, sf).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in best.items()}
    assert all(abs(got[k][0] - best[k][0]) <= 0.005 + 1e-9 for k in best)


def test_ranking_has_projects_and_domain(spark, sf):
    import duckdb

    from rosterlake import catalogue

    db = duckdb.connect()
    for name in ("orders", "lineitem", "part", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    neutral = catalogue._RANKED_SQL[: catalogue._RANKED_SQL.rindex(",\no AS")]
    want = db.execute(f"""WITH {neutral},
    five AS (SELECT * FROM (SELECT o_custkey AS candidate_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5),
    texts AS (SELECT candidate_id, o_orderkey, lower(string_agg(p_name, ' ' ORDER BY l_linenumber, p_name)) AS text FROM five JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    words AS (SELECT job_id, list(DISTINCT lower(skill)) AS words FROM job_skills GROUP BY job_id),
    p AS (SELECT candidate_id, job_id, round(count(*) FILTER (len(list_filter(words, lambda w: contains(text, w))) >= 2) * 100.0::DOUBLE / count(*), 2) AS project FROM texts CROSS JOIN words GROUP BY ALL),
    d AS (SELECT a.vec_id AS candidate_id, b.vec_id AS job_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) * 50, 2) AS domain FROM embeddings AS a CROSS JOIN embeddings AS b)
    SELECT candidate_id, job_id, coalesce(project, 30), coalesce(domain, 50), skill_score * 0.4 + experience_score * 0.25 + coalesce(project, 30) * 0.2 + coalesce(domain, 50) * 0.15 FROM r LEFT JOIN p USING (candidate_id, job_id) LEFT JOIN d USING (candidate_id, job_id)""").fetchall()
    got = {(r.candidate_id, r.job_id): r for r in catalogue._ranked(spark, sf).collect()}
    assert len(want) == len(got) and len({r.project_score for r in got.values()}) > 2 and len({r.domain_score for r in got.values()}) > 2
    for c, j, project, domain, overall in want:
        r = got[c, j]
        assert r.project_score == project and abs(r.domain_score - domain) < 0.011 and abs(r.overall - overall) < 0.002


def test_projects_and_domain_where_something_is_missing(spark):
    projects = [(1, 1, "Rest API with Redis"), (1, 2, "redis alone"), (2, 3, "nothing")]
    asked = [(7, "REST API", 2, "nice"), (7, "redis", 3, "nice"), (7, "rest", 1, "required"), (8, "api redis", 1, "required")]
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])]
    left, right = profiles(spark, [(c, "x") for c in (1, 2, 3, 4)], asked, projects, vectors, [(7, [-2.0, 0.0]), (8, [3.0, 0.0])])
    got = {(r.candidate_id, r.job_id): r for r in ranking.count_pairs(left, right).collect()}
    assert {k: (r.relevant, r.n_projects) for k, r in got.items() if r.n_projects} == {(1, 7): (1, 2), (1, 8): (0, 2), (2, 7): (0, 1), (2, 8): (0, 1)}
    scored = {(r.candidate_id, r.job_id): (r.project_score, r.domain_score) for r in ranking.score_pairs(ranking.count_pairs(left, right)).collect()}
    assert {k: d for k, (_, d) in scored.items()} == {(1, 7): 0.0, (1, 8): 100.0, (2, 7): 50.0, (2, 8): 50.0, **{(c, j): 50.0 for c in (3, 4) for j in (7, 8)}} and scored[3, 7][0] == 30.0
    scores = spark.createDataFrame([(1, 2), (None, 1), (None, None)], "relevant long, n long").select(C.project_score(F.col("relevant"), F.col("n")).alias("s"))
    assert [r.s for r in scores.collect()] == [50.0, 0.0, 30.0]


def test_many_projects_all_count(spark):
    projects = [(1, p, "redis and kafka" if p % 2 else "redis") for p in range(200)]
    left, right = profiles(spark, [(1, "x"), (2, "y")], [(7, "redis", 1, "required"), (7, "kafka", 2, "required")], projects)
    got = {r.candidate_id: (r.n_projects, r.relevant) for r in ranking.count_pairs(left, right).collect()}
    assert got == {1: (200, 100), 2: (None, 0)}


def matching(a, b):
    """Whether two skills match, in any of the ways, by the definitions."""
    def norm(s):
        out = re.sub(r"[\s-]+", " ", re.sub(r"[^\w\s-]", "", s.lower().strip())).strip()
        words = out.split(" ")
        return f"{words[0]} {L.PLURALS.get(words[1], words[1])}" if len(words) == 2 else out

    def variations(n):
        out = {n} | {norm(v) for v in L.SKILL_ALIASES.get(n, [])}
        for main, others in L.SKILL_ALIASES.items():
            if n in [norm(o) for o in others]:
                out |= {norm(main), *map(norm, others)}
        return out

    x, y = norm(a), norm(b)
    if x == y or variations(x) & variations(y):
        return True
    if min(len(x), len(y)) >= 4 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.85:
        return True
    one = lambda n: n.rstrip("s") if n.endswith("s") and len(n) > 3 else n
    if one(x) == one(y) and len(one(x)) >= 3:
        return True
    return (x in y or y in x) and min(len(x), len(y)) >= 4 and abs(len(x) - len(y)) <= 3 and tuple(sorted((x, y))) not in {tuple(sorted(p)) for p in L.NOT_THE_SAME}


def test_skills_are_met_in_every_way(spark):
    own = ["JS", "Rest APIs", "postgresql", "Spring Boot", "cold bolt", "java", "react.js", "dockers", "kubernets", "C++", "c", "Data-Science", "!!!", "ai"]
    asked = ["javascript", "rest api", "postgres", "java", "old bolt", "javascripts", "reactjs", "docker", "kubernetes", "C", "data science", "aI", "spring", "???", "net"]
    left, right = profiles(spark, [(1, s) for s in own] + [(2, "zzz")], [(j, s, 1, "required") for j, s in enumerate(asked)])
    got = {(r.candidate_id, r.job_id): r for r in ranking.count_pairs(left, right, lacking=True).collect()}
    for j, want in enumerate(asked):
        met = any(matching(want, s) for s in own)
        assert (got[1, j].required, got[1, j].missing) == (int(met), [] if met else [want]), want
        assert got[2, j].required == 0 and got[1, j].n_skills == 13
    with_nothing = ranking.score_pairs(ranking.count_pairs(left, right)).filter("candidate_id = 2").agg(F.max("skill_score")).first()[0]
    assert with_nothing == 0.0


def test_blocks_of_jobs_give_the_same_pairs(spark, sf, monkeypatch):
    from rosterlake import catalogue

    candidates, jobs = catalogue._profiles(spark, sf)
    counted = lambda: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in ranking.count_pairs(candidates, jobs).collect()}  # noqa: E731  a product's last bits depend on its shape
    whole = counted()
    real = ranking.meet
    monkeypatch.setattr(ranking, "meet", lambda *a, **k: real(*a, **k, block_rows=3))
    assert counted() == whole
    monkeypatch.undo()
    every = ranking.score_pairs(ranking.count_pairs(candidates, jobs)).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for by, other in (("job", "candidate"), ("candidate", "job")):
        some = ranking.score_pairs(ranking.count_pairs(candidates, jobs, best=(by, 3)))
        assert rows(ranking.top_per(some, f"{by}_id", "overall", f"{other}_id", 3)) == rows(ranking.top_per(every, f"{by}_id", "overall", f"{other}_id", 3))
    total = candidates.count()
    top = ranking.top_with_percentile(ranking.score_pairs(ranking.count_pairs(candidates, jobs, best=("job", 3))), "job_id", "overall", "candidate_id", 3, total)
    assert rows(top) == rows(ranking.top_with_percentile(every, "job_id", "overall", "candidate_id", 3, total))


def test_a_candidate_that_fails_keeps_the_others(spark):
    left, right = profiles(spark, [(c, "sql") for c in (1, 2, 3)], [(7, "sql", 1, "required"), (8, "go", 1, "required")], (), [(2, [float("inf"), 1.0]), (1, [1.0, 0.0])], [(7, [1.0, 1.0])])
    got = {(r.candidate_id, r.job_id): r for r in ranking.score_pairs(ranking.count_pairs(left, right)).collect()}
    assert len(got) == 6 and {k for k, r in got.items() if r.error} == {(2, 7), (2, 8)} and all(got[2, j].overall is None for j in (7, 8))
    assert got[1, 7].skill_score == 70.0 and got[3, 8].overall is not None


def test_percentiles_of_any_group(spark):
    rows = [("hot", float(i % 7) if i % 3 else 2.0, i) for i in range(3000)] + [(f"g{i % 5}", float(i % 4), i) for i in range(50)] + [(None, 1.0, 1), (None, None, 2), ("one", 5.0, 1)] + [("flat", 1.0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, t long").repartition(5)
    want = {(r.g, r.t): r.p for r in df.withColumn("p", ranking.percentile("s", "g")).collect()}
    for parts in ("3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = ranking.group_percentiles(df, "g", "s", "t")
        assert {(r.g, r.t): r.percentile_rank for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ranking.group_percentiles(df.limit(0), "g", "s", "t").collect() == []


def test_opposite_vectors_are_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    half = rng.normal(size=(100, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([half, -half]))], "k long, v array<double>")
    got = ranking.nearest(vectors, vectors, "k", "v", 199, block=16).collect()
    assert len(got) == 200 * 199 and all(r.query_id != r.k for r in got)


@pytest.mark.parametrize("block", [2, 100_000])
def test_lexicon_equals_contains(spark, block):
    texts = ["the react team", "reactive", "", "ab" * 50, None, "naïve café", "AB", "react"]
    terms = ["react", "act", "re", "ab", "ba", "caf", "é", "", "zzz", "ab" * 20, None, "react"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    lex = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.k, r.term) for r in lexicon.lexicon_join(df, "text", lex, "term", block_rows=block).collect()}
    known = [t for t in dict.fromkeys(terms) if t is not None]
    assert got == {(k, t) for k, x in enumerate(texts) if x is not None for t in known if t in x}
    in_text = df.select("k", C.automaton.found(F.col("text"), known).alias("f")).collect()
    assert {r.k: r.f for r in in_text} == {k: [t for t in known if x is not None and t in x] for k, x in enumerate(texts)}


def test_large_lexicon_takes_one_pass(spark):
    import time

    terms = [f"term{i}x" for i in range(100_000)]
    text = " ".join(f"term{i}x" for i in range(0, 100_000, 500)) + " plain words" * 2000
    known = C.automaton.automaton(terms)
    began = time.time()
    assert len(C.automaton.numbers_in(text, known)) == 200
    few = C.automaton.automaton(terms[:100])
    spent, began = time.time() - began, time.time()
    C.automaton.numbers_in(text, few)
    assert spent < 20 * (time.time() - began) + 0.2


def test_meeting_is_every_row_with_every_block(spark):
    import pyarrow as pa

    side, rows = spark.range(23).toDF("s"), spark.range(50).toDF("r")

    def start(block):
        return [b["s"] for b in block]

    def work(block, batch):
        yield pa.RecordBatch.from_arrays([pa.array([s for s in block for _ in range(batch.num_rows)]), pa.array([r for _ in block for r in batch.column(0).to_pylist()])], names=["s", "r"])

    got = meet.meet(side, rows, start, work, "s long, r long", block_rows=4).collect()
    assert len(got) == 23 * 50 == len(set(map(tuple, got)))
    assert meet.meet(side.limit(0), rows, start, work, "s long, r long").collect() == meet.meet(side, rows.limit(0), start, work, "s long, r long").collect() == []


def test_long_project_descriptions_stay_whole(spark):
    from rosterlake.functions import resumes as T

    entry = "Shop platform\n" + "\n".join(f"line {i}" for i in range(1500))
    got = spark.createDataFrame([(entry,)], "e string").select(T.project_entry(F.col("e")).alias("p")).first().p
    assert got.description.count("\n") == 1499 and got.description.endswith("line 1499")


def test_best_pairs_against_scores_of_all_pairs(spark):
    import random

    deal = random.Random(5)
    words = [f"{a}{b}" for a in "qwxz" for b in ("alpha", "bravo", "kilo", "tango")]
    skills = [(c, w) for c in range(1500) for w in deal.sample(words, deal.randint(1, 8))]
    asked = [(j, w, i + 1, "required" if i < 3 and j % 5 else "nice") for j in range(9) for i, w in enumerate(deal.sample(words, 5))]
    projects = [(c, p, " ".join(deal.sample(words, 4))) for c in range(0, 1500, 2) for p in range(deal.choice([1, 5, 12, 70]) if c < 100 else 3)]
    left, right = profiles(spark, skills, asked, projects, [(c, [float(c % 7) - 3, 1.0]) for c in range(0, 1500, 3)], [(j, [1.0, float(j)]) for j in range(0, 9, 2)], [(c, c % 9) for c in range(0, 1500, 5)])
    left = left.withColumn("stored", F.when(F.col("candidate_id") % 10 == 0, F.array(F.struct(F.lit(4).cast("long").alias("job_id"), F.lit(99.0).alias("overall"))))).cache()
    every = ranking.score_pairs(ranking.count_pairs(left, right)).cache()
    assert every.count() == 1500 * 9
    for by, other, n in (("job", "candidate", 4), ("candidate", "job", 2)):
        some = ranking.score_pairs(ranking.count_pairs(left, right, best=(by, n)))
        rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in ranking.top_per(df, f"{by}_id", "overall", f"{other}_id", n).collect())  # noqa: E731, B023
        assert [r[:2] for r in rows(some)] == [r[:2] for r in rows(every)]


def test_a_task_gives_out_the_best_of_all_that_it_saw(spark):
    stored = F.array(F.struct(F.lit(1).cast("long").alias("job_id"), (F.col("candidate_id") * 0.05).alias("overall")))
    left, right = profiles(spark, [(c, "sql") for c in range(1500)], [(1, "sql", 1, "required")])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = [r.candidate_id for r in ranking.count_pairs(left.withColumn("stored", stored), right, best=("job", 4)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) >= {1496, 1497, 1498, 1499} and len(got) <= 4 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_replies_meet_pairs_without_a_join(spark, sf):
    import re as regex

    from rosterlake import catalogue

    plan = catalogue.score_override(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not regex.search("Join|Exchange", above)
