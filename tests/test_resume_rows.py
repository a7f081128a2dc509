"""Parses of résumés: a text is read within its own row, each entry, name and link once."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import columns as C
from rosterlake.functions import records as N
from rosterlake.functions import resumes as T
from rosterlake.operators import cascade
from rosterlake.operators import resumes as R

TEXT = "Ana Gray\nana@gmail.com, www.ana.dev\n\nEXPERIENCE\nLead Engineer at North Ltd\n2001 - 2004\n- led it\n\nSKILLS\nTools: docker, Vue\nGo\nMore: vue\n"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parse", [cascade.by_headers, cascade.by_content])
def test_sections_are_read_in_their_row(spark, parse):
    rows = spark.createDataFrame([(TEXT,), ("",), (None,)], "text string")
    out = parse(rows)
    assert not any(word in plan(out) for word in ("Join", "Aggregate [", "Window", "Generate", "Repartition"))
    got = {r.text: r for r in out.collect()}
    work = [(e.title, e.company, e.start_date, e.end_date, e.description) for e in got[TEXT].experience]
    assert work == [("Lead Engineer", "North Ltd", "2001", "2004", "- led it")] and got[TEXT].skills[0] == "docker"
    assert all(got[t].experience == [] and got[t].skills == [] for t in ("", None))


def test_an_entry_is_read_once(spark):
    entry = T.work_entry(F.col("e"))
    out = spark.createDataFrame([("Lead Engineer at North Ltd\n2001 - 2004",), (None,)], "e string").select(entry.alias("x"))
    # a range is looked for twice and cut out twice; without binding, once for each use of what hangs on it
    assert out._jdf.queryExecution().analyzed().toString().count("PRESENT|CURRENT") <= 4
    assert [r.x.company if r.x else None for r in out.collect()] == ["North Ltd", None]


def test_links_are_looked_for_once(spark):
    rows = spark.createDataFrame([(TEXT,)], "text string")
    out = cascade.stored_record(cascade.by_headers(rows).withColumn("parser", F.lit("headers")), 2024)
    assert plan(out).count("regexp_extract_all(") == 1
    got = out.first()
    assert (got.portfolio_url, got.github_url, got.first_name, got.years) == ("https://www.ana.dev", None, "Ana", 3)


def test_listed_skills_by_category(spark):
    rows = [("Tools: docker, Vue\nQuery\n\nMore: vue", ["docker", "Vue Query", "vue"]), ("no category\nat all", []), ("", []), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.s for r in df.select(T.listed_skills(F.col("t")).alias("s")).collect()] == [w for _, w in rows]


def test_bound_value_may_be_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.x for r in df.select(C.let(F.upper("t"), lambda u: F.coalesce(F.concat(u, u), F.lit("none"))).alias("x")).collect()] == ["AA", "none"]
    forms = df.select(N.company_forms(F.when(F.col("t") == "a", "Kanto Soft Ltd")).alias("f"))
    assert [r.f for r in forms.collect()] == [["kanto soft ltd", "kanto soft", "kanto"], []]


@pytest.mark.parametrize("text, want", [
    ("led\nx", []), ("1999 - 2001\nnone\n2003-2004", [("experience", 0, 2)]), ("Senior\nDeveloper\nthe company", []), ("x\nsenior dev\nthe company", [("experience", 1, 2)]),
    ("tools\n: a", []), ("\U0001f600\nİ\nthe College", [("education", 2, 2)]), ("react vue\naws\nreact vue aws\ntools: x", [("skills", 2, 3)]), ("app\nhttps://a.b\napp HTTPS://a.b\napp https://a.b\nz", [("projects", 3, 4)]),
])
def test_content_begins_within_a_line(spark, text, want):
    got = R.content_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    assert [(r.section, r.start, r.end) for r in got] == want
