"""Stand-in résumés and layout blocks over the given tables, for Spark and as SQL.

No table holds résumés, so each customer's is written from its orders. The pieces are plain expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

_NL = "chr(10)"
_TITLE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Lead Engineer' WHEN '2' THEN 'Senior Developer' WHEN '3' THEN 'Data Analyst' WHEN '4' THEN 'Night Porter' ELSE 'Junior Designer' END"
_COMPANY = "CASE o_orderstatus WHEN 'O' THEN 'Unit ' || chr(65 + CAST(o_orderkey % 26 AS INT)) || ' Systems' WHEN 'F' THEN 'Northern Parts Ltd' ELSE 'Pune University' END"
_DATES = "year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || ' - ' || CASE o_orderstatus WHEN 'O' THEN 'PRESENT' ELSE CAST(year(o_orderdate) + 1 AS STRING) END"
_ENTRY = f"""CASE o_orderkey % 4 WHEN 0 THEN title || ' at ' || company || {_NL} || dates || {_NL} || '- built part ' || o_orderkey WHEN 1 THEN company || {_NL} || title || {_NL} || dates || {_NL} || '- managed stock'
  WHEN 2 THEN title || ' - ' || company || {_NL} || dates ELSE 'Bachelor of Physics' || {_NL} || company || {_NL} || dates END"""
_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Ben' WHEN 2 THEN 'CHI' ELSE 'Dov' END || ' ' || CASE c_custkey % 5 WHEN 0 THEN 'Gray' WHEN 1 THEN 'Ito' WHEN 2 THEN 'KHAN' WHEN 3 THEN 'Lund Berg' ELSE 'Moss' END"
_HEAD = f"CASE WHEN c_custkey % 6 = 0 THEN 'Curriculum Vitae' || {_NL} ELSE '' END || {_NAME} || {_NL} || 'c' || c_custkey || '@gmail.com, 555-010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ', github.com/c' || c_custkey || ', www.site' || c_custkey || '.dev'"
_SKILLS = f"CASE WHEN c_custkey % 7 <> 0 THEN {_NL} || {_NL} || 'SKILLS' || {_NL} || 'Frontend: React, Vue, ' || c_mktsegment || ', react' || {_NL} || 'Tools: docker; Git / Jenkins | developed own tools' || {_NL} || 'and more' ELSE '' END"
_WORK = f"CASE WHEN experience IS NOT NULL THEN {_NL} || {_NL} || 'EXPERIENCE' || {_NL} || experience ELSE '' END"
_SCHOOL = f"CASE WHEN c_custkey % 3 <> 0 THEN {_NL} || {_NL} || 'EDUCATION' || {_NL} || 'Master of Science' || {_NL} || 'Applied Physics, North College, ' || (1990 + c_custkey % 30) || {_NL} || {_NL} || 'Diploma in Trade' ELSE '' END"
_PROJECTS = f"CASE WHEN c_custkey % 4 <> 1 THEN {_NL} || {_NL} || 'PROJECTS' || {_NL} || 'Stock Finder' || {_NL} || 'Search in Python and React, https://github.com/c' || c_custkey || '/finder' || {_NL} || {_NL} || 'A versatile tool that was built over many years for finding parts in stores, with a name that is far too long' ELSE '' END"
_LAST = f"{_NL} || {_NL} || 'CERTIFICATIONS' || {_NL} || 'Cloud Practitioner, Scrum; QA' || {_NL} || {_NL} || 'LANGUAGES' || {_NL} || 'English (fluent), French (basic)' || {_NL} || 'x'"
_TEXT = " || ".join(f"({p})" for p in (_HEAD, _SKILLS, _WORK, _SCHOOL, _PROJECTS, _LAST))

RESUMES = f"""entries AS (SELECT o_custkey, o_orderkey, {_TITLE} AS title, {_COMPANY} AS company, {_DATES} AS dates FROM orders),
written AS (SELECT o_custkey, string_agg({_ENTRY}, {_NL} || {_NL} ORDER BY o_orderkey) AS experience FROM entries GROUP BY o_custkey),
resumes AS (SELECT c_custkey AS candidate_id, {_TEXT} AS text FROM customer LEFT JOIN written ON o_custkey = c_custkey)"""
RESUME_LINES = f"{RESUMES}, resume_lines AS (SELECT candidate_id, i - 1 AS line_no, l[i] AS line FROM (SELECT candidate_id, string_split(text, chr(10)) AS l FROM resumes), unnest(generate_series(1, len(l))) AS t(i))"


#: A third of the résumés as they are, a third without headings, a third hardly any text, some none; a company of some has a skill's name.
_BARE = "text"
for _head in ("SKILLS", "EXPERIENCE", "EDUCATION", "PROJECTS", "CERTIFICATIONS", "LANGUAGES"):
    _BARE = f"replace({_BARE}, {_NL} || '{_head}' || {_NL}, {_NL})"
_MIXED = f"CASE WHEN candidate_id % 6 = 0 THEN replace(text, 'Northern Parts', 'Northern Jenkins') WHEN candidate_id % 3 = 0 THEN text WHEN candidate_id % 3 = 1 THEN {_BARE} WHEN candidate_id % 9 = 2 THEN 'Notes of c' || candidate_id || ', who wrote python and sql' WHEN candidate_id % 9 = 5 THEN '' END"
MIXED_RESUMES = RESUMES.replace("resumes AS (", "headed AS (", 1) + f", resumes AS (SELECT candidate_id, {_MIXED} AS text FROM headed)"


def mixed_resumes(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, text): résumés of unequal worth to a parser."""
    return resumes(spark, d).selectExpr("candidate_id", f"{_MIXED} AS text")


def resumes(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, text): a résumé for each customer, with a work entry for each of its orders."""
    entries = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", f"{_TITLE} AS title", f"{_COMPANY} AS company", f"{_DATES} AS dates")
    listed = F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(_ENTRY).alias("entry"))))
    written = entries.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["entry"]), "\n\n").alias("experience"))
    # Texts grow with the orders, so they are not broadcast: customers alone may be a single task.
    joined = table(spark, d, "customer").join(written.hint("merge"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.selectExpr("c_custkey AS candidate_id", f"{_TEXT} AS text")


#: Lines of an order as layout blocks: one page an order, the line number down, price and quantity across.
_BLOCK = ["l_orderkey AS doc", "CAST(0 AS INT) AS page", "CAST(CAST(l_linenumber AS INT) * 18 % 50 AS DOUBLE) AS top", "CAST(CASE WHEN l_returnflag = 'R' THEN 340 ELSE 20 END + CAST(l_quantity AS INT) % 9 AS DOUBLE) AS left_edge", "CAST(600 AS DOUBLE) AS page_width", "CAST(l_partkey AS STRING) || ' ' || repeat('word ', 24) AS text"]
BLOCKS = f"blocks AS (SELECT {', '.join(_BLOCK)} FROM lineitem)"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, top, left, page_width, text)."""
    return table(spark, d, "lineitem").selectExpr(*_BLOCK).withColumnRenamed("left_edge", "left")
