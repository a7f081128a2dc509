"""The cascade of résumé parsers: what each stage sees, what the record holds, odd rows."""

from pyspark.sql import functions as F

from rosterlake.operators import cascade

HEADED = "Ana Gray\nana@x.example, 555-010-0001, github.com/ana\n\nSKILLS\nTools: docker, Jenkins, react\n\nEXPERIENCE\nLead Engineer at Jenkins Software\n2001 - 2004\n\nData Analyst at North Ltd\n2010-02 - PRESENT\n\nEDUCATION\nMaster of Science\nApplied Physics, North College, 1999\n"
BARE = HEADED.replace("SKILLS\n", "").replace("EXPERIENCE\n", "").replace("EDUCATION\n", "")
DDL = "doc string, body string, parser int, text string, _hash int, score int"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}" if i else None, t, 5, "own", 6, 7) for i, t in enumerate(texts)], DDL)


def test_record_of_each_stage(spark):
    texts = [HEADED, BARE, "I write python", "nothing at all", "", None, HEADED, HEADED + "x" * 300_000]
    got = cascade.parse_resumes(docs(spark, *texts).withColumnRenamed("_hash", "hash"), "body", 2024).collect()
    assert len(got) == len(texts)
    by = {r.doc: r for r in got}
    assert {k: r.parser for k, r in by.items()} == {None: "headers", "d1": "content", "d2": "rules", "d3": "none", "d4": "none", "d5": "none", "d6": "headers", "d7": "headers"}
    first = by[None]
    assert (first.first_name, first.last_name, first.email, first.github_url) == ("Ana", "Gray", "ana@x.example", "https://github.com/ana")
    assert [(e.title, e.company, e.start_date, e.end_date) for e in first.experience] == [("Lead Engineer", "Jenkins Software", "2001", "2004"), ("Data Analyst", "North Ltd", "2010-02", "present")]
    assert first.skills == ["docker", "react"] and first.years == 3 + 14 and [e.degree for e in first.education] == ["Master of Science"]
    # 2 skills 5, years 20, two entries 15, one school 10, over 200 characters 5, three kinds 5, told by headers 8
    assert len(HEADED) > 200 and first.score == 68 and first.tier == "moderate" and not first.may_match
    assert first.completeness == 0.32 and first.quality == 32  # name, e-mail, phone 1.5, entries 1, school 0.5, skills 0.2
    assert by["d6"].asDict() | {"doc": None} == first.asDict() and first.text == "own"
    # lexicon words count as substrings, so "write" holds r
    assert by["d2"].skills == ["python", "r"] and by["d2"].experience == [] and by["d2"].years is None and by["d2"].score == 0
    assert by["d5"].skills == [] and by["d5"].email is None and by["d5"].first_name == "unknown" and by["d5"].score == 0


def test_stage_sees_only_what_is_left(spark):
    seen = {}

    def stage(name, fits):
        def parse(rows):
            seen[name] = sorted(r.id for r in rows.collect())
            return rows.withColumn("hit", F.col("id") % fits == 0)

        return parse

    got = cascade.in_turn(spark.range(12), {"a": stage("a", 2), "b": stage("b", 3)}, F.col("hit"))
    assert seen == {"a": list(range(12)), "b": [1, 3, 5, 7, 9, 11]}
    assert {r.id: r.parser for r in got.collect()} == {i: "a" if i % 2 == 0 else "b" if i % 3 == 0 else "none" for i in range(12)}


def test_single_entry_without_dates_counts_half(spark):
    from rosterlake.functions import columns as C

    df = spark.createDataFrame([(1, True), (1, False), (2, False)], "n int, dated boolean")
    zero = F.lit(0)
    score = C.parse_quality(zero, zero, F.col("n"), zero, zero, zero, zero, F.lit(0.0), F.lit(False), F.col("dated"))
    assert [r.s for r in df.select(score.alias("s")).collect()] == [10, 5, 15]
