"""Skills of job posts: a section is cut out once a text, however many words are looked for."""

from pyspark.sql import functions as F

from rosterlake.functions import lexicons as L
from rosterlake.functions import resumes as T


def test_sections_are_cut_once(spark):
    texts = ["Requirements: Python, Scala\nnice to have: Docker", "You must know c++ and react.\nfull-stack: html, api", "none", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    required, nice = T.post_skills(F.col("text"), L.JOB_SKILLS)
    out = df.select("id", required.alias("r"), nice.alias("n"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 2
    got = {r.id: r for r in out.collect()}
    assert {"python", "scala"} <= set(got[0].r) and "docker" in got[0].n and {"c++", "react", "html", "rest api"} == set(got[1].r)
    assert all(got[i].r == [] and got[i].n == [] for i in (2, 3, 4))
