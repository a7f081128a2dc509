"""Registered queries over parsed records, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _MARKED, _QUALITY_SQL, _RANKED_SQL, _marked, _profiles, _quality, _query, _top
from .functions import lexicons as L
from .functions import records as R
from .operators import ranking, records
from .plans import views as V
from .sources.tables import table
from .sources.work import work_table


@_query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'Lead' END AS role, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS company,
  CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m') END AS stop, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS now, CASE WHEN o_totalprice > 100000 THEN [o_orderpriority, ' ', NULL, o_orderstatus] ELSE [' '] END AS tasks FROM orders)
SELECT o_orderkey, coalesce(nullif(role, ''), nullif(title, 'unknown'), 'N/A') AS title, coalesce(company, 'N/A') AS company, coalesce(stop, CASE WHEN now THEN 'Present' END, 'N/A') AS end_date,
  coalesce(nullif(array_to_string(list_transform(list_filter(tasks, lambda x: x IS NOT NULL AND trim(x) <> ''), lambda x: '• ' || x), chr(10)), ''), nullif(title, 'unknown'), '') AS description FROM e""")
def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    """Orders as experience entries of mixed shape, brought to one."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    title = F.when(k % 5 == 0, "unknown").otherwise(F.col("o_orderpriority"))
    parts = {
        "role": F.when(k % 3 == 0, "").when(k % 3 == 1, "Lead"), "title": title, "position": F.lit(None).cast("string"), "company": F.when(k % 7 != 0, status), "organization": F.lit(" "), "start_date": F.lit(None).cast("string"),
        "end_date": F.when(status != "O", F.date_format("o_orderdate", "yyyy-MM")), "is_current": (status == "O") & (k % 2 == 0), "responsibilities": F.when(F.col("o_totalprice") > 100000, F.array(F.col("o_orderpriority"), F.lit(" "), F.lit(None), status)).otherwise(F.array(F.lit(" "))), "description": title,
    }
    e = table(spark, d, "orders").select(k, F.struct(*[c.alias(n) for n, c in parts.items()]).alias("e"))
    return e.select("o_orderkey", R.entry_fields(F.col("e")).alias("x")).select("o_orderkey", "x.title", "x.company", "x.end_date", "x.description")


@_query(f"""WITH {V.CANDIDATE_SKILLS}, s AS (SELECT candidate_id, count(*) AS n FROM candidate_skills GROUP BY candidate_id),
o AS (SELECT o_custkey, count(*) AS jobs, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS schools, count(*) FILTER (WHERE o_orderstatus = 'F') AS projects FROM orders GROUP BY o_custkey)
SELECT c_custkey AS candidate_id, round(((trim(c_name) <> '')::INTEGER * 0.5::DOUBLE + (c_nationkey % 3 <> 0)::INTEGER * 0.5::DOUBLE + (c_custkey % 2 = 0)::INTEGER * 0.5::DOUBLE + (n_name IS NOT NULL)::INTEGER * 0.5::DOUBLE
  + least(coalesce(jobs, 0) * 0.5::DOUBLE, 3) + least(coalesce(schools, 0) * 0.5::DOUBLE, 1) + least(coalesce(s.n, 0) * 0.1::DOUBLE, 2) + least(coalesce(projects, 0) * 0.3::DOUBLE, 1) + (c_acctbal > 0)::INTEGER) / 10, 2) AS completeness
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN s ON s.candidate_id = c_custkey""")
def profile_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Customers as profiles; their orders count as jobs, urgent ones as schools, finished ones as projects."""
    owned = V.candidate_skills(spark, d).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("skills"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("schools"), F.count_if(F.col("o_orderstatus") == "F").alias("projects"))
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "candidate_id").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(o, "candidate_id", "left").join(owned, "candidate_id", "left")
    identity = [F.col("c_name"), F.when(F.col("c_nationkey") % 3 != 0, "a@b.example"), F.when(F.col("candidate_id") % 2 == 0, "555").otherwise("unknown"), F.col("n_name")]
    return c.select("candidate_id", R.completeness(identity, F.col("jobs"), F.col("schools"), F.col("skills"), F.col("projects"), F.when(F.col("c_acctbal") > 0, 0.6)).alias("completeness"))


@_query(f"""WITH {_MARKED}, s AS (SELECT doc_id, avg(CASE section WHEN 'list' THEN 0.5 ELSE 0.9 END::DOUBLE) AS c, count(DISTINCT line_no % 2) > 1 AS spread FROM marked WHERE section IS NOT NULL GROUP BY doc_id)
SELECT doc_id, round(least(0.95::DOUBLE, 0.5::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 0.8::DOUBLE * 0.3::DOUBLE ELSE 0 END + coalesce(c * 0.4::DOUBLE, 0) + CASE WHEN spread THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM documents LEFT JOIN s USING (doc_id)""")
def layout_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Sections on odd and even lines count as two columns."""
    sections = _marked(spark, d).filter("section IS NOT NULL").groupBy("doc_id").agg(F.avg(F.when(F.col("section") == "list", 0.5).otherwise(0.9)).alias("c"), (F.count_distinct(F.col("line_no") % 2) > 1).alias("spread"))
    docs = table(spark, d, "documents").select("doc_id").join(sections, "doc_id", "left")
    return docs.select("doc_id", F.round(R.layout_confidence(F.when(F.col("doc_id") % 3 == 0, 0.8), F.col("c"), F.col("spread")), 6).alias("confidence"))


_SAY = L.EXPLANATIONS


@_query(f"""WITH {_RANKED_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, candidate_id) AS rank_position FROM o) WHERE rank_position <= 20),
m AS (SELECT t.candidate_id, t.job_id, coalesce(list(j.skill ORDER BY j.rn) FILTER (WHERE s.skill IS NOT NULL AND kind = 'required'), []) AS yes, coalesce(list(j.skill ORDER BY j.rn) FILTER (WHERE s.skill IS NULL AND kind = 'required'), []) AS miss,
  count(*) FILTER (WHERE kind = 'required') AS n_required, count(*) FILTER (WHERE kind = 'nice') AS n_nice, count(s.skill) FILTER (WHERE kind = 'nice') AS nice FROM t JOIN job_skills AS j USING (job_id) LEFT JOIN met_skills AS s ON s.candidate_id = t.candidate_id AND s.skill = j.skill GROUP BY t.candidate_id, t.job_id),
g AS (SELECT m.*, t.skill_score, coalesce(tenure.years, 0) - jobs.years AS gap FROM m JOIN t USING (candidate_id, job_id) JOIN jobs USING (job_id) LEFT JOIN tenure USING (candidate_id))
SELECT candidate_id, job_id, list_filter([CASE WHEN n_required > 0 THEN printf('{_SAY["required"]}', len(yes)::VARCHAR, n_required::VARCHAR) END, CASE WHEN n_nice > 0 THEN printf('{_SAY["nice"]}', nice::VARCHAR) END, CASE WHEN len(yes) > 0 THEN printf('{_SAY["matched"]}', array_to_string(yes[1:5], ', ')) END,
    CASE WHEN gap > 0 THEN printf('{_SAY["more_years"]}', gap::VARCHAR) END, CASE WHEN skill_score >= 70 THEN printf('{_SAY["strong"]}', round(skill_score)::BIGINT::VARCHAR) END], lambda x: x IS NOT NULL) AS strengths,
  list_filter([CASE WHEN len(miss) > 0 THEN printf('{_SAY["missing"]}', len(miss)::VARCHAR, array_to_string(miss[1:5], ', ')) END, CASE WHEN gap < 0 THEN printf('{_SAY["fewer_years"]}', (-gap)::VARCHAR) END, CASE WHEN skill_score < 50 THEN printf('{_SAY["limited"]}', round(skill_score)::BIGINT::VARCHAR) END], lambda x: x IS NOT NULL) AS weaknesses FROM g""")
def explanation_facts(spark: SparkSession, d: str) -> DataFrame:
    """Strengths and weaknesses of the 20 best candidates of every job."""
    candidates, jobs = _profiles(spark, d)
    candidates = work_table(candidates, "candidates")
    top = _top(candidates, jobs, "job", 20).select("candidate_id", "job_id", "skill_score", (F.coalesce("have", F.lit(0)) - F.col("years")).alias("gap"))
    own = candidates.select("candidate_id", "met").dropDuplicates(["candidate_id"])
    each = top.join(own, "candidate_id", "left").join(V.job_skills(spark, d), "job_id")
    required, has = F.col("kind") == "required", F.coalesce(F.array_contains("met", F.col("skill")), F.lit(False))

    def listed(which):
        return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("rn", "skill")))), lambda x: x["skill"])

    facts = each.groupBy("candidate_id", "job_id", "skill_score", "gap").agg(listed(required & has).alias("yes"), listed(required & ~has).alias("miss"), F.count_if(required).alias("n_required"), F.count_if(~required).alias("n_nice"), F.count_if(~required & has).alias("nice"))
    strengths, weaknesses = R.explanation(F.col("n_required"), F.col("yes"), F.col("miss"), F.col("n_nice"), F.col("nice"), F.col("gap"), F.col("skill_score"))
    return facts.select("candidate_id", "job_id", strengths.alias("strengths"), weaknesses.alias("weaknesses"))


@_query(r"""SELECT doc_id, doc_id % 8 = 0 AND text IS NOT NULL AS changed, len(regexp_extract_all(text, '[a-z]+')) + CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 0 END AS words FROM documents""")
def reparse_changed(spark: SparkSession, d: str) -> DataFrame:
    """A patch for every fourth document, of which every second one really changes the text."""
    def words(docs: DataFrame) -> DataFrame:
        return docs.withColumn("words", F.regexp_count("text", F.lit("[a-z]+")).cast("long"))

    base = words(table(spark, d, "documents").select("doc_id", "text"))
    patch = base.filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit(" two more"))).otherwise(F.col("text")).alias("text"))
    return records.reparse_changed(base, patch, "doc_id", "text", ["words"], words).select("doc_id", "changed", "words")


@_query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, s_name) AS name, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, n_name) AS place
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def personal_info(spark: SparkSession, d: str) -> DataFrame:
    """The stored row comes first, the parsed one fills its gaps."""
    stored = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("unknown").alias("place"))
    parsed = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("n_name").alias("place"))
    return records.fill_gaps(stored, parsed, "c_custkey", ["name", "place"])


@_query(f"{_QUALITY_SQL}, r AS (SELECT doc_id, score, CASE WHEN doc_id % 5 <> 0 THEN score + doc_id % 25 END AS better FROM q) SELECT doc_id, coalesce(score < 70 AND better > score + 10, false) AS refined, CASE WHEN score < 70 AND better > score + 10 THEN better ELSE score END AS final FROM r")
def refined_parse(spark: SparkSession, d: str) -> DataFrame:
    """The refined parse is taken only where it clearly helps."""
    s = _quality(spark, d).withColumn("better", F.when(F.col("doc_id") % 5 != 0, F.col("score") + F.col("doc_id") % 25))
    chosen = s.withColumn("refined", R.prefer_refined(F.col("score"), F.col("better")))
    return chosen.select("doc_id", "refined", F.when(F.col("refined"), F.col("better")).otherwise(F.col("score")).cast("long").alias("final"))


@_query(f"""WITH {V.CANDIDATE_SKILLS}, c AS (SELECT DISTINCT o_custkey AS candidate_id, string_split(p_name, ' ')[1] AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND o_orderpriority = '1-URGENT'),
f AS (SELECT candidate_id, unnest([w || ' software ltd', w || ' software', w]) AS form FROM c)
SELECT candidate_id, skill FROM candidate_skills AS s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.candidate_id = s.candidate_id AND (contains(lower(skill), form) OR length(skill) >= 4 AND contains(form, lower(skill))))""")
def company_skill_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Skills without those that name a company of the same candidate."""
    line = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey")
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    named = urgent.join(line, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    companies = named.select("candidate_id", F.concat(F.initcap(F.get(F.split("p_name", " "), 0)), F.lit(" Software Ltd")).alias("company"))
    return records.drop_company_skills(V.candidate_skills(spark, d), companies, "candidate_id", "skill", "company")


def _clean_sql() -> str:
    bare = "trim(raw)"
    for pattern in L.SKILL_NOISE:
        bare = f"regexp_replace({bare}, '{pattern}', '', 'g')"
    some = " OR ".join(f"contains(lower(bare), '{w}')" for w in L.SKILL_PHRASE_NAMES)
    return f"""b AS (SELECT *, {bare} AS bare FROM raw), n AS (SELECT *, regexp_replace(trim(regexp_replace(bare, '{L.SKILL_ALTERNATIVES}', '')), '[.,;:]+$', '') AS name FROM b),
s AS (SELECT p_partkey, CASE WHEN length(trim(raw)) <= 35 AND NOT (regexp_matches(bare, '{L.SKILL_PHRASE}') AND NOT ({some})) AND len(regexp_split_to_array(trim(name), '\\s+')) <= 3 AND length(name) >= 2 THEN name END AS skill FROM n)"""


def _any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(skill), '{w}')" for w in words) + ")"


@_query(rf"""WITH raw AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'like ' || p_name WHEN 1 THEN p_name || ' (expert) ' WHEN 2 THEN p_name || ' / other' WHEN 3 THEN 'using ' || p_name || '.' WHEN 4 THEN p_name || ' 2019 - 2020' WHEN 5 THEN 'developed ' || p_name WHEN 6 THEN p_size || '.' || p_size ELSE upper(p_name) END AS raw FROM part), {_clean_sql()}
SELECT p_partkey, skill, coalesce(length(skill) BETWEEN 2 AND 50 AND NOT (regexp_matches(lower(trim(skill)), '^[\d./-]+$') OR lower(trim(skill)) IN ({', '.join(repr(w) for w in L.SKILL_STOP_WORDS)}) OR regexp_matches(skill, '\b(?:19|20)\d{{2}}\s*[-–—]') OR {_any_sql(L.COMPANY_MARKS)} OR {_any_sql(L.ACTION_VERBS)})
  AND (regexp_matches(skill, '[A-Z./0-9]') AND length(skill) <= 30 OR regexp_matches(skill, '^[a-z]{{3,15}}$')), false) AS valid FROM s""")
def cleaned_skills(spark: SparkSession, d: str) -> DataFrame:
    """Part names written as people list skills, cleaned and judged."""
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    ways = [F.concat(F.lit("like "), n), F.concat(n, F.lit(" (expert) ")), F.concat(n, F.lit(" / other")), F.concat(F.lit("using "), n, F.lit(".")), F.concat(n, F.lit(" 2019 - 2020")), F.concat(F.lit("developed "), n), F.concat("p_size", F.lit("."), "p_size"), F.upper(n)]
    raw = F.coalesce(*[F.when(k == i, w) for i, w in enumerate(ways)])
    cleaned = table(spark, d, "part").select("p_partkey", R.clean_skill(raw).alias("skill"))
    return cleaned.withColumn("valid", R.valid_skill(F.col("skill")))
