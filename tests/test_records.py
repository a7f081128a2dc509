import pytest
from pyspark.sql import functions as F

from rosterlake.functions import records as R
from rosterlake.operators import records


@pytest.mark.parametrize("raw, want", [
    ("like Django", "Django"), ("React (3 years)", "React"), ("SQL / Oracle", "SQL"), ("using REST API", "REST API"), ("Acme 2019 - 2020", "Acme"), ("x", None), ("developed the whole thing", None), ("w x y z", None), ("w" * 36, None), (None, None), ("", None),
])
def test_clean_skill(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(R.clean_skill(F.col("s")).alias("x")).first()["x"] == want


def test_valid_skill(spark):
    rows = [("HTML5", True), ("python", True), ("12.5", False), ("the", False), ("Acme Solutions", False), ("managed teams", False), (None, False)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert [r.x for r in df.select(R.valid_skill(F.col("s")).alias("x")).collect()] == [r[1] for r in rows]


def test_company_skills_go(spark):
    companies = spark.createDataFrame([(1, "Kanto Software Ltd"), (1, None), (1, "unknown"), (2, "IBM")], "id int, company string")
    skills = spark.createDataFrame([(1, "kanto"), (1, "Kanto cloud"), (1, "software"), (1, "ltd"), (1, "sql"), (2, "kanto"), (2, "ibm mq"), (3, "ibm")], "id int, skill string")
    got = {(r.id, r.skill) for r in records.drop_company_skills(skills, companies, "id", "skill", "company").collect()}
    assert got == {(1, "ltd"), (1, "sql"), (2, "kanto"), (3, "ibm")}


def test_reparse_only_changed(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "d", 40)], "id int, text string, n int")
    patch = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, None)], "id int, text string")
    got = records.reparse_changed(base, patch, "id", "text", ["n"], lambda t: t.withColumn("n", F.length("text")))
    assert sorted((r.id, r.text, r.n, r.changed) for r in got.collect()) == [(1, "a", 10, False), (2, "bb", 2, True), (3, "ccc", 3, True), (4, "d", 40, False)]


def test_gaps_and_scores(spark):
    one = spark.createDataFrame([(1, "unknown", "x"), (2, None, " ")], "id int, a string, b string")
    two = spark.createDataFrame([(1, "p", "q")], "id int, a string, b string")
    assert sorted((r.id, r.a, r.b) for r in records.fill_gaps(one, two, "id", ["a", "b"]).collect()) == [(1, "p", "x"), (2, None, None)]
    no = F.lit(None).cast("double")
    row = spark.range(1).select(R.completeness([F.lit("unknown")], no, no, no, no, no).alias("c"), R.layout_confidence(no, no, no.cast("boolean")).alias("l"), R.prefer_refined(F.lit(60), F.lit(71)).alias("yes"), R.prefer_refined(F.lit(60), no).alias("no")).first()
    assert (row.c, row.l, row.yes, row.no) == (0.0, 0.5, True, False)
