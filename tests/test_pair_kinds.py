"""Pairs by kinds: the same rows as pairs counted one by one, with scores worked out once a kind."""

import pytest
from pyspark.sql import functions as F

from rosterlake import catalogue
from rosterlake.functions import columns as C
from rosterlake.operators import ranking


@pytest.fixture(scope="module")
def sides(spark, sf):
    return [df.cache() for df in catalogue._profiles(spark, sf)]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("together, tile", [(8192, 1 << 18), (7, 20)])
def test_kinds_give_the_pairs(spark, sides, monkeypatch, together, tile):
    monkeypatch.setattr(ranking, "_KINDRED", together)
    monkeypatch.setattr(ranking, "_TILE", tile)
    one_by_one = ranking.score_pairs(ranking.count_pairs(*sides, lacking=True), "missing", "n_skills").cache()
    skill = ranking.expand(ranking.pair_kinds(*sides, ("skills",)), ranking.skill_column)
    assert rows(skill) == rows(one_by_one.select("candidate_id", "job_id", "n_skills", F.col("skill_score").alias("value")))
    missing = ranking.expand(ranking.pair_kinds(*sides, ("lacking",)), lambda k: k["missing"])
    assert rows(missing) == rows(one_by_one.select("candidate_id", "job_id", "n_skills", F.col("missing").alias("value")))
    project = ranking.expand(ranking.pair_kinds(*sides, ("projects",)), lambda k: C.project_score(k["relevant"], k["n_projects"]))
    assert rows(project) == rows(one_by_one.select("candidate_id", "job_id", "n_skills", F.col("project_score").alias("value")))


def test_kinds_are_few(spark, sides):
    tiles = ranking.pair_kinds(*sides, ("skills",)).select(F.size("codes").alias("pairs"), F.size("kinds").alias("kinds"))
    got = tiles.agg(F.sum("pairs").alias("pairs"), F.max("kinds").alias("kinds")).first()
    assert got.pairs == sides[0].count() * sides[1].count() and got.kinds <= 6 * 4 * 6


def test_a_candidate_that_fails_has_its_error_in_all_pairs(spark):
    left = spark.createDataFrame([(1, ["sql"], 1, [1.0]), (2, [], 2, [float("nan")]), (None, ["sql"], 3, None)], "candidate_id long, met array<string>, n_skills int, a array<double>")
    right = spark.createDataFrame([(7, ["sql"], [], ["sql"]), (8, [], ["go"], ["go"])], "job_id long, required array<string>, nice array<string>, words array<string>")
    got = {(r.candidate_id, r.job_id): (r.n_skills, *r.value) for r in ranking.expand(ranking.pair_kinds(left, right, ("skills", "vectors")), lambda k: F.struct(k["required"], k["n_nice"], k["error"].isNotNull())).collect()}
    assert got == {(1, 7): (1, 1, 0, False), (1, 8): (1, 0, 1, False), (2, 7): (2, None, None, True), (2, 8): (2, None, None, True), (None, 7): (3, 1, 0, False), (None, 8): (3, 0, 1, False)}


@pytest.mark.parametrize("levels", [4096, 3])
def test_percentiles_without_a_sort_of_pairs(spark, sides, monkeypatch, levels):
    scored = ranking.score_pairs(ranking.count_pairs(*sides)).select("job_id", "candidate_id", "skill_score", "overall")
    want = rows(scored.withColumn("p", ranking.percentile("overall", "job_id")).select("job_id", "candidate_id", "skill_score", F.col("p").alias("percentile_rank")))
    sorted_pairs = []
    real = ranking.group_percentiles
    monkeypatch.setattr(ranking, "group_percentiles", lambda *a: sorted_pairs.append(a) or real(*a))
    monkeypatch.setattr(ranking, "_LEVELS", levels)
    assert rows(ranking.pair_percentiles(*sides)) == want
    assert bool(sorted_pairs) == (levels == 3)


def test_scores_of_kinds_in_tasks_are_those_of_columns_to_the_bit(spark):
    import numpy as np
    import pyarrow as pa

    left = [(c, ["sql", "go", "c"][: c % 4], c % 9, (None, 0, 1, 3, 12)[c % 5], (None, 0, 3, 7)[c % 4], [{"word": "sql", "places": [0, 1]}, {"word": "go", "places": [1]}] if c % 4 == 3 else None, [float(c), 1.0, 0.3] if c % 3 else None) for c in range(60)]
    right = [(j, ["sql", "go", "c"][: j % 4], ["x", "go"][: j % 3], ["sql", "go"], j % 8, [0.1 * j, 1.0, 2.0] if j % 2 else None) for j in range(40)]
    schema = "candidate_id long, met array<string>, n_skills int, have long, n_projects long, found array<struct<word: string, places: array<int>>>, a array<double>"
    left, right = spark.createDataFrame(left, schema), spark.createDataFrame(right, "job_id long, required array<string>, nice array<string>, words array<string>, years int, b array<double>")
    pairs = ranking.score_pairs(ranking.count_pairs(left, right)).collect()
    block = ranking.JobBlock([r.asDict() for r in right.collect()])
    some = ranking.Candidates(block, pa.RecordBatch.from_struct_array(pa.array([r.asDict(recursive=True) for r in left.collect()], pa.struct([("candidate_id", pa.int64()), ("met", pa.list_(pa.string())), ("n_skills", pa.int32()), ("have", pa.int64()), ("n_projects", pa.int64()), ("found", pa.list_(pa.struct([("word", pa.string()), ("places", pa.list_(pa.int32()))]))), ("a", pa.list_(pa.float64()))]))))
    which, who = (x.ravel() for x in np.indices((40, 60)))
    skill, overall = some.scores(which, who, some.count_some(which, who))
    got = {(int(c), int(j)): (s, o) for c, j, s, o in zip(who, which, skill, overall)}
    assert len(pairs) == 2400 and got == {(r.candidate_id, r.job_id): (r.skill_score, r.overall) for r in pairs}


def test_replies_are_carried_by_tiles_not_by_pairs(spark, sf, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs left Python one by one")

    monkeypatch.setattr(ranking, "count_pairs", refuse)
    got = catalogue.score_override(spark, sf)
    assert got.count() == got.select("candidate_id").distinct().count() * got.select("job_id").distinct().count()


def test_tiles_carry_numbers_of_candidates(spark):
    left = spark.createDataFrame([(1, ["sql"], 1, 2.5, [1.0]), (2, [], 2, None, [float("nan")]), (None, ["sql"], 3, 7.0, None)], "candidate_id long, met array<string>, n_skills int, reply double, a array<double>")
    right = spark.createDataFrame([(7, ["sql"], [], ["sql"])], "job_id long, required array<string>, nice array<string>, words array<string>")
    pairs = ranking.expand(ranking.pair_kinds(left, right, ("skills",), carry=("reply",)), lambda k: k["required"], "reply")
    assert sorted(map(repr, ((r.candidate_id, r.reply, r.value) for r in pairs.collect()))) == sorted(map(repr, [(1, 2.5, 1), (2, None, None), (None, 7.0, 1)]))
