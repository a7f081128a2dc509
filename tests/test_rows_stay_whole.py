"""Text operators that read each text within its own row: the same results, and no shuffle or sort of lines."""

import pytest

from rosterlake.operators import lines
from rosterlake.operators import resumes as R

DDL = "id int, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unmoved(df):
    assert not any(word in plan(df) for word in ("Exchange", "Window", "Sort"))
    return df.collect()


def test_simple_entries(spark):
    texts = spark.createDataFrame([(1, "\n\n  one\n \ntwo\none 2\n\n\ntwo 3"), (2, "one"), (3, ""), (4, None), (5, "none\n"), (6, "x\n \n")], DDL)
    got = unmoved(R.simple_entries(texts, "id", "text", {"a": "one", "b": "two"}))
    assert sorted((r.id, r.entry_no, r.a, r.b) for r in got) == [(1, 2, "one", None), (1, 3, "one 2", "two"), (1, 5, None, "two 3"), (2, 0, "one", None), (5, 0, "none", None)]


def test_listed_after(spark):
    texts = spark.createDataFrame([(1, "a\nMY Word:\n- b\n\n word c\n•- d\n e\nf"), (2, "word"), (3, "a"), (4, None), (5, "word\n \nx")], DDL)
    got = unmoved(lines.listed_after(texts, "id", "text", "Word", 3))
    assert {r.id: r["items"] for r in got} == {1: ["b", "d", "e"], 5: ["x"]}


@pytest.mark.parametrize("text, want", [
    ("Bachelor\nx\n\n\ny", [("education", 0, 2, "Bachelor\nx\n")]),
    ("x\nBachelor\nx\nSKILLS\ny", [("education", 1, 2, "Bachelor\nx")]),
    ("Bachelor\n" + "x\n" * 60, [("education", 0, 50, "Bachelor\n" + "\n".join(["x"] * 50))]),
    ("Tools: git\nx", [("skills", 0, 1, "Tools: git\nx")]), ("2001 - 2002", []), ("", []), (None, []),
])
def test_content_sections(spark, text, want):
    got = unmoved(R.content_sections(spark.createDataFrame([(1, text)], DDL), "id", "text"))
    assert sorted((r.section, r.start, r.end, r.body) for r in got) == want
