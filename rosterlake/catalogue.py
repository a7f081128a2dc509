"""Registered queries of the matching engine, each over whole tables, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import lexicons as L
from .operators import intervals, lines, ranking, skills, upserts
from .plans import skill_sql as Q
from .plans import views as V
from .sources.tables import page, table
from .sources.work import work_table
from .streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scoring and ranking ------------------------------------------------------------------------------------


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, jobs), a row each with all that a pair's scores need. What is read more than once is a work table."""
    own, asked = work_table(V.candidate_skills(spark, d), "candidate-skills"), work_table(V.job_skills(spark, d), "job-skills")
    years = intervals.tenure(V.experience(spark, d), "candidate_id", "start", "end").select("candidate_id", F.col("years").alias("have"))
    met = ranking.met_skills(own, asked, skills.alias_table(spark))
    candidates = ranking.candidate_profiles(own, met, years, V.projects(spark, d), asked, V.vectors(spark, d, "candidate_id"))
    return candidates, work_table(ranking.job_profiles(asked, V.jobs_of(asked).select("job_id", "years"), V.vectors(spark, d, "job_id")), "jobs")


def _skill_profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, jobs) with skills only."""
    own, asked = work_table(V.candidate_skills(spark, d), "candidate-skills"), work_table(V.job_skills(spark, d), "job-skills")
    met = ranking.met_skills(own, asked, skills.alias_table(spark))
    return ranking.skill_profiles(own, met), work_table(ranking.job_skill_profiles(asked), "jobs")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with all four scores and their weighted overall; 30 where a candidate has no project, 50 where a side has no vector."""
    return ranking.score_pairs(ranking.count_pairs(*_profiles(spark, d)))


def _top(candidates: DataFrame, jobs: DataFrame, by: str, n: int) -> DataFrame:
    """The n best pairs of each job or candidate, scored as _ranked does."""
    group, tie = ("job_id", "candidate_id") if by == "job" else ("candidate_id", "job_id")
    return ranking.best_of_group(candidates, jobs, by, n, lambda pairs: ranking.top_per(pairs, group, "overall", tie, n))


_RANKED_SQL = f"""RECURSIVE {V.BASE}, {V.EXPERIENCE}, {V.TENURE}, {Q.SCORED}, {V.PROJECT_SCORES}, {V.DOMAIN_SCORES},
x AS (SELECT candidate_id, job_id, skill_score, coalesce(t.years, 0) - scored.years AS gap, scored.years AS wanted FROM scored LEFT JOIN tenure AS t USING (candidate_id)),
r AS (SELECT candidate_id, job_id, skill_score, CASE WHEN wanted = 0 THEN 70.0::DOUBLE WHEN gap = 0 THEN 100.0::DOUBLE WHEN gap BETWEEN 1 AND 2 THEN 95.0::DOUBLE WHEN gap BETWEEN 3 AND 5 THEN 90.0::DOUBLE WHEN gap > 5 THEN 85.0::DOUBLE
    WHEN gap >= -1 THEN 80.0::DOUBLE WHEN gap >= -2 THEN 60.0::DOUBLE WHEN gap >= -3 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS experience_score FROM x),
o AS (SELECT *, skill_score * 0.4::DOUBLE + experience_score * 0.25::DOUBLE + coalesce(project_score, 30.0::DOUBLE) * 0.2::DOUBLE + coalesce(domain_score, 50.0::DOUBLE) * 0.15::DOUBLE AS overall
  FROM r LEFT JOIN project_scores USING (candidate_id, job_id) LEFT JOIN domain_scores USING (candidate_id, job_id))"""


@_query(f"""WITH {_RANKED_SQL},
p AS (SELECT *, round((rank() OVER (PARTITION BY job_id ORDER BY overall) - 1) * 100.0::DOUBLE / count(*) OVER (PARTITION BY job_id), 2) AS percentile_rank, row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, candidate_id) AS rank_position FROM o)
SELECT job_id, candidate_id, skill_score, experience_score, floor(overall * 100 + 0.50000001::DOUBLE) / 100 AS overall_score, CASE WHEN overall >= 80 THEN 'high' WHEN overall >= 60 THEN 'medium' ELSE 'low' END AS confidence_level, percentile_rank, rank_position FROM p WHERE rank_position <= 20""")
def rank_candidates_for_job(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best candidates of every job, with percentile over all its candidates."""
    candidates, jobs = _profiles(spark, d)
    candidates = work_table(candidates, "candidates")
    total = candidates.agg(F.count_distinct("candidate_id").alias("n")).first()["n"]
    top = ranking.best_of_group(candidates, jobs, "job", 20, lambda pairs: ranking.top_with_percentile(pairs, "job_id", "overall", "candidate_id", 20, total))
    return top.select("job_id", "candidate_id", "skill_score", "experience_score", C.cents(F.col("overall")).alias("overall_score"), C.confidence_tier(F.col("overall")).alias("confidence_level"), "percentile_rank", "rank_position")


@_query(f"""WITH {_RANKED_SQL} SELECT candidate_id, arg_max(job_id, row(overall, -job_id)) AS job_id, floor(max(overall) * 100 + 0.50000001::DOUBLE) / 100 AS best_score FROM o GROUP BY candidate_id""")
def best_job_per_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Stored pairs keep their score, every other pair is scored, and the best job over all pairs is kept.

    No table holds stored scores, so pairs of a candidate and a supplier of its orders are scored beforehand.
    """
    candidates, jobs = _profiles(spark, d)
    candidates = work_table(candidates, "candidates")
    known = V.stored_matches(spark, d).groupBy("candidate_id").agg(F.collect_list("job_id").alias("wanted"))
    stored = ranking.score_pairs(ranking.count_pairs(candidates.join(known, "candidate_id"), jobs)).select("candidate_id", "job_id", "overall")
    return ranking.best_with_stored(candidates, jobs, work_table(stored, "stored"))


@_query(f"WITH RECURSIVE {V.BASE}, {Q.SCORED} SELECT candidate_id, job_id, n_skills, skill_score FROM scored")
def all_pairs_skill_score(spark: SparkSession, d: str) -> DataFrame:
    """A row for every pair of candidate and job; rank_candidates_for_job and best_job_per_candidate give the best ones alone."""
    pairs = ranking.expand(ranking.pair_kinds(*_skill_profiles(spark, d), ("skills",)), ranking.skill_column)
    return pairs.select("candidate_id", "job_id", F.col("n_skills").cast("long").alias("n_skills"), F.col("value").alias("skill_score"))


@_query(f"""WITH RECURSIVE {V.CANDIDATE_SKILLS}, {V.JOB_SKILLS}, {Q.MET}, c AS (SELECT DISTINCT candidate_id FROM candidate_skills),
m AS (SELECT candidate_id, job_id, list(j.skill ORDER BY rn) FILTER (WHERE s.skill IS NULL) AS missing, count(s.skill) AS matched FROM c CROSS JOIN (SELECT job_id, skill, rn FROM job_skills WHERE kind = 'required') AS j LEFT JOIN met_skills AS s USING (candidate_id, skill) GROUP BY candidate_id, job_id)
SELECT candidate_id, job_id, matched, coalesce(missing, []) AS missing, CASE WHEN matched >= 4 THEN 'strong' WHEN matched < 2 THEN 'limited' ELSE 'partial' END AS fit FROM m""")
def missing_skills(spark: SparkSession, d: str) -> DataFrame:
    """Which of each job's required skills each candidate does not meet in any way, in the job's order: a row for every pair of candidate and job."""
    tiles, matched = ranking.pair_kinds(*_skill_profiles(spark, d), ("lacking",)), F.col("value.required")
    pairs = ranking.expand(tiles, lambda k: F.struct(k["required"].alias("required"), k["missing"].alias("missing")))
    return pairs.select("candidate_id", "job_id", matched.cast("long").alias("matched"), "value.missing", F.when(matched >= 4, "strong").when(matched < 2, "limited").otherwise("partial").alias("fit"))


@_query(f"""WITH {_RANKED_SQL} SELECT job_id, candidate_id, skill_score, round((rank() OVER (PARTITION BY job_id ORDER BY overall) - 1) * 100.0::DOUBLE / count(*) OVER (PARTITION BY job_id), 2) AS percentile_rank FROM o""")
def pair_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The percentile of every candidate among all candidates of each job: a row for every pair."""
    candidates, jobs = _profiles(spark, d)
    return ranking.pair_percentiles(work_table(candidates, "candidates"), jobs)


@_query(f"""WITH {_RANKED_SQL}, reply AS (SELECT user_id AS candidate_id, CAST(json_extract(max(props), '$.k') AS DOUBLE) AS experience_score FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT candidate_id, job_id, skill_score, coalesce(reply.experience_score, o.experience_score) AS experience_score FROM o LEFT JOIN reply USING (candidate_id)""")
def score_override(spark: SparkSession, d: str) -> DataFrame:
    """Scores that a JSON reply gives replace the computed ones, column by column; a row for every pair of candidate and job."""
    text = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("props").alias("reply"))
    reply = text.select(F.col("user_id").alias("candidate_id"), F.from_json(C.json_in_text(F.concat(F.lit("Reply: "), F.col("reply"))), "k double")["k"].alias("experience_score"))
    own, asked = work_table(V.candidate_skills(spark, d), "candidate-skills"), work_table(V.job_skills(spark, d), "job-skills")
    met = ranking.met_skills(own, asked, skills.alias_table(spark))
    years = intervals.tenure(V.experience(spark, d), "candidate_id", "start", "end").select("candidate_id", F.col("years").alias("have"))
    unit = V.vectors(spark, d, "candidate_id").select("candidate_id", ranking.unit_vector(F.col("vector")).alias("a"))
    # The reply stands in the candidate's row, so the pairs need no join; projects do not bear on these scores, a vector that cannot be read does.
    replied = ranking.skill_profiles(own, met).join(years, "candidate_id", "left").join(unit, "candidate_id", "left").join(reply.withColumnRenamed("experience_score", "reply"), "candidate_id", "left")
    jobs = work_table(ranking.job_profiles(asked, V.jobs_of(asked).select("job_id", "years"), V.vectors(spark, d, "job_id")), "jobs")
    tiles = ranking.pair_kinds(replied, jobs.drop("b"), ("skills", "years"), carry=("reply",))
    scores = lambda k: F.when(k["error"].isNull(), F.struct(ranking.skill_column(k).alias("skill"), C.experience_score(k["have"], k["years"]).alias("experience")))
    return ranking.expand(tiles, scores, "reply").select("candidate_id", "job_id", F.col("value.skill").alias("skill_score"), F.coalesce("reply", "value.experience").alias("experience_score"))


@_query(f"""WITH {_RANKED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, candidate_id) AS rank_position FROM o)
SELECT t.job_id, rank_position, c_name AS name, n_name AS nation, s_name AS company, '{{"candidate_id":' || candidate_id || ',"confidence":"' || CASE WHEN overall >= 80 THEN 'high' WHEN overall >= 60 THEN 'medium' ELSE 'low' END || '","recommendation":"' || CASE WHEN overall >= 60 THEN 'Moderate Match' ELSE 'Weak Match' END || '"}}' AS payload
FROM t JOIN customer ON c_custkey = candidate_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = job_id WHERE rank_position <= 5""")
def ranking_payload(spark: SparkSession, d: str) -> DataFrame:
    """Ranked pairs enriched with names and nested as JSON."""
    top = _top(*_profiles(spark, d), "job", 5)
    c, n, s = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "supplier")
    joined = top.join(c, F.col("c_custkey") == F.col("candidate_id")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("s_suppkey") == F.col("job_id"), "left")
    payload = F.to_json(F.struct("candidate_id", C.confidence_tier(F.col("overall")).alias("confidence"), C.recommendation(F.col("overall")).alias("recommendation")))
    return joined.select("job_id", "rank_position", C.display_name(F.col("c_name"), F.lit("")).alias("name"), F.col("n_name").alias("nation"), F.col("s_name").alias("company"), payload.alias("payload"))


@_query(f"WITH {V.JOB_SKILLS}, {V.PROJECT_SCORES} SELECT candidate_id, job_id, project_score FROM project_scores")
def project_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a candidate's last five projects that name at least two of a job's required or nice skills; a row for every pair of candidate and job."""
    asked = work_table(V.job_skills(spark, d), "job-skills")
    candidates = ranking.project_profiles(V.projects(spark, d), asked).filter("candidate_id IS NOT NULL")
    tiles = ranking.pair_kinds(candidates, work_table(ranking.job_skill_profiles(asked), "jobs"), ("projects",))
    pairs = ranking.expand(tiles, lambda k: C.project_score(k["relevant"], k["n_projects"]))
    return pairs.select("candidate_id", "job_id", F.col("value").alias("project_score"))


@_query("""WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id, round((list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + 1) * 50, 6) AS score FROM q JOIN embeddings ON vec_id <> q)
SELECT q AS query_id, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each query vector (ids divisible by 50) by cosine, scaled to 0-100."""
    e = table(spark, d, "embeddings")
    return ranking.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


# --- skill joins --------------------------------------------------------------------------------------------

#: Vocabulary from the tables: words of part names and of event JSON, with variants that the joins should find.
_VOCABULARY = """raw AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) || 's' FROM part
  UNION ALL SELECT upper(p_name) || '!' FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT event_type || 'ing' FROM events UNION ALL SELECT lower(n_name) FROM nation))"""
_TERMS_SQL = f"{_VOCABULARY}, terms AS (SELECT term, {Q.norm_sql('term')} AS norm FROM raw WHERE term <> '')"


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p, e, n = table(spark, d, "part"), table(spark, d, "events").select("event_type").distinct(), table(spark, d, "nation")
    word = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    every = word.union(word.select(F.concat("w", F.lit("s")))).union(p.select(F.concat(F.upper("p_name"), F.lit("!"))).distinct()).union(e).union(e.select(F.concat("event_type", F.lit("ing")))).union(n.select(F.lower("n_name")))
    return skills.terms(every, "w")


@_query(f"""WITH {_TERMS_SQL}, raw_alias AS (SELECT k AS raw_key, {Q.norm_sql('k')} AS k, {Q.norm_sql('v')} AS v FROM (VALUES {Q.ALIASES}) AS t(k, v)),
alias AS (SELECT DISTINCT k AS norm, v AS variation FROM raw_alias WHERE k = raw_key UNION SELECT DISTINCT a.v, b.v FROM raw_alias AS a JOIN raw_alias AS b USING (raw_key) WHERE a.v <> a.k),
every AS (SELECT term, norm FROM terms UNION SELECT k, k FROM raw_alias), s AS (SELECT term, norm AS variation FROM every UNION SELECT term, variation FROM every JOIN alias USING (norm))
SELECT DISTINCT a.term AS l, b.term AS r FROM s AS a JOIN s AS b USING (variation) WHERE a.term < b.term""")
def alias_skill_join(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the vocabulary and the alias lexicon whose one-hop variations meet."""
    keys = spark.createDataFrame([(k, v) for k, vs in L.SKILL_ALIASES.items() for v in vs], "k string, v string").select(C.normalize_skill(F.col("k")).alias("term"))
    every = _vocabulary(spark, d).unionByName(keys.distinct().withColumn("norm", F.col("term"))).distinct()
    return skills.alias_join(every, every, skills.alias_table(spark)).filter("l < r")


@_query(f"""WITH {_TERMS_SQL}, s AS (SELECT term, CASE WHEN ends_with(norm, 's') AND length(norm) > 3 THEN regexp_replace(norm, 's+$', '') ELSE norm END AS k FROM terms)
SELECT a.term AS l, b.term AS r FROM s AS a JOIN s AS b USING (k) WHERE length(k) >= 3 AND a.term < b.term""")
def plural_skill_join(spark: SparkSession, d: str) -> DataFrame:
    t = _vocabulary(spark, d)
    return skills.plural_join(t, t).filter("l < r")


@_query(f"""WITH {_TERMS_SQL} SELECT DISTINCT a.term AS l, b.term AS r FROM terms AS a JOIN terms AS b ON (contains(a.norm, b.norm) OR contains(b.norm, a.norm)) AND least(length(a.norm), length(b.norm)) >= 4 AND abs(length(a.norm) - length(b.norm)) <= 3
WHERE a.term < b.term AND NOT list_contains(['java|javascript', 'javascript|js', 'internet|net', 'go|golang'], least(a.norm, b.norm) || '|' || greatest(a.norm, b.norm))""")
def containment_skill_join(spark: SparkSession, d: str) -> DataFrame:
    t = _vocabulary(spark, d)
    return skills.containment_join(t, t).filter("l < r")


@_query(f"WITH {_TERMS_SQL} SELECT a.term AS l, b.term AS r, levenshtein(a.norm, b.norm) AS distance FROM terms AS a JOIN terms AS b ON a.term < b.term WHERE levenshtein(a.norm, b.norm) <= 1")
def levenshtein_skill_join(spark: SparkSession, d: str) -> DataFrame:
    t = _vocabulary(spark, d)
    return skills.levenshtein_join(t, t).filter("l < r")


@_query(f"WITH RECURSIVE {_TERMS_SQL}, {Q.RATIOS} SELECT l, r, ratio FROM ratios WHERE ratio >= 0.85::DOUBLE")
def fuzzy_skill_join(spark: SparkSession, d: str) -> DataFrame:
    """The ratio depends on the side that comes first, so both orders are kept."""
    t = _vocabulary(spark, d)
    return skills.fuzzy_join(t, t).filter("l <> r")


@_query(f"""WITH RECURSIVE {_TERMS_SQL}, {Q.RATIOS}, raw_alias AS (SELECT k AS raw_key, {Q.norm_sql('k')} AS k, {Q.norm_sql('v')} AS v FROM (VALUES {Q.ALIASES}) AS t(k, v)),
alias AS (SELECT DISTINCT k AS norm, v AS variation FROM raw_alias WHERE k = raw_key UNION SELECT DISTINCT a.v, b.v FROM raw_alias AS a JOIN raw_alias AS b USING (raw_key) WHERE a.v <> a.k), s AS (SELECT term, norm AS variation FROM terms UNION SELECT term, variation FROM terms JOIN alias USING (norm)),
p AS (SELECT term, CASE WHEN ends_with(norm, 's') AND length(norm) > 3 THEN regexp_replace(norm, 's+$', '') ELSE norm END AS k FROM terms)
SELECT l, r FROM ratios WHERE ratio >= 0.85::DOUBLE UNION SELECT a.term, b.term FROM s AS a JOIN s AS b USING (variation) WHERE a.term <> b.term UNION SELECT a.term, b.term FROM p AS a JOIN p AS b USING (k) WHERE length(k) >= 3 AND a.term <> b.term
UNION SELECT a.term, b.term FROM terms AS a JOIN terms AS b ON (contains(a.norm, b.norm) OR contains(b.norm, a.norm)) AND least(length(a.norm), length(b.norm)) >= 4 AND abs(length(a.norm) - length(b.norm)) <= 3
  WHERE a.term <> b.term AND NOT list_contains(['java|javascript', 'javascript|js', 'internet|net', 'go|golang'], least(a.norm, b.norm) || '|' || greatest(a.norm, b.norm))""")
def combined_skill_match(spark: SparkSession, d: str) -> DataFrame:
    t = _vocabulary(spark, d)
    return skills.combined_join(t, t, skills.alias_table(spark)).filter("l <> r")


# --- tenure and seniority -----------------------------------------------------------------------------------


@_query(f"WITH {V.EXPERIENCE}, {V.TENURE} SELECT candidate_id, days, years, CASE WHEN floor(floor(days / 365.25::DOUBLE * 2 + 0.5::DOUBLE) / 2) >= 1 THEN CAST(floor(floor(days / 365.25::DOUBLE * 2 + 0.5::DOUBLE) / 2) AS BIGINT) END AS half_years FROM tenure")
def tenure_merged(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tenure(V.experience(spark, d), "candidate_id", "start", "end")


@_query(f"WITH {V.EXPERIENCE} SELECT candidate_id, CAST(sum(greatest(0, year(e) - year(s))) AS BIGINT) AS years FROM experience GROUP BY candidate_id")
def tenure_simple(spark: SparkSession, d: str) -> DataFrame:
    return intervals.simple_years(V.experience(spark, d), "candidate_id", "start", "end")


@_query(f"""WITH {V.EXPERIENCE}, {V.TENURE}, j AS (SELECT o_custkey AS candidate_id, count(*) AS jobs, bool_or(o_orderpriority = '1-URGENT') AS leads FROM orders GROUP BY o_custkey)
SELECT candidate_id, years, CASE WHEN leads AND years >= 10 THEN 'principal' WHEN leads AND years >= 8 THEN 'lead' WHEN leads AND years >= 5 THEN 'senior' WHEN years = 0 THEN 'intern' WHEN years < 2 THEN 'junior' WHEN years < 5 THEN 'mid' WHEN years < 8 THEN 'senior' WHEN years < 12 THEN 'lead' ELSE 'principal' END AS level,
  round(CASE WHEN leads THEN least(0.95::DOUBLE, c + 0.1::DOUBLE) ELSE c END, 2) AS confidence, jobs >= 3 AND years / jobs::DOUBLE < 1.0 AS job_hopping, round(years / jobs::DOUBLE, 4) AS mean_years
FROM (SELECT *, CASE WHEN years = 0 THEN 0.9 WHEN years < 2 THEN 0.85 WHEN years < 5 THEN 0.8 WHEN years < 8 THEN 0.75 WHEN years < 12 THEN 0.7 ELSE 0.65 END::DOUBLE AS c FROM tenure JOIN j USING (candidate_id))""")
def seniority_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level and confidence by years and titles, with the job-hopping flag and the mean years of a job."""
    years = intervals.tenure(V.experience(spark, d), "candidate_id", "start", "end")
    jobs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count(F.lit(1)).alias("jobs"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("leads"))
    level, sure = C.seniority(F.col("years"), F.col("leads"))
    mean = F.col("years") / F.col("jobs")
    return years.join(jobs, "candidate_id").select("candidate_id", "years", level.alias("level"), F.round(sure, 2).alias("confidence"), ((F.col("jobs") >= 3) & (mean < 1)).alias("job_hopping"), F.round(mean, 4).alias("mean_years"))


# --- documents ----------------------------------------------------------------------------------------------


def _hits_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INTEGER" for w in words) + ")"


_VALIDITY_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
c AS (SELECT doc_id, length(trim(text)) >= 200 AS long, regexp_matches(text, '{L.EMAIL}') AS email, regexp_matches(text, '{L.LOOSE_PHONE}') AS phone, len(regexp_extract_all(upper(text), '{L.DATE_RANGE}')) AS ranges,
  {", ".join(f"{_hits_sql(w)} AS {k}" for k, (_, _, w) in L.VALIDITY_FAMILIES.items())}, {_hits_sql(L.OTHER_DOCUMENTS)} AS other FROM t),
s AS (SELECT *, CASE WHEN long THEN email::INTEGER * 15 + phone::INTEGER * 10 + (ranges >= 2)::INTEGER * 10 + {" + ".join(f"least({k} * {each}, {most})" for k, (each, most, _) in L.VALIDITY_FAMILIES.items())} - least(other * 5, 30)
  + (email AND phone)::INTEGER * 5 + (experience > 0 AND education > 0)::INTEGER * 5 ELSE 0 END AS score FROM c)"""


@_query(f"{_VALIDITY_SQL} SELECT doc_id, score, long AND score >= 30 AS is_valid FROM s")
def document_validity(spark: SparkSession, d: str) -> DataFrame:
    return C.with_validity(table(spark, d, "documents"), "text").select("doc_id", "score", "is_valid")


@_query(f"""{_VALIDITY_SQL} SELECT doc_id, CASE WHEN long AND score >= 30 THEN 'pending' ELSE 'failed' END AS status, list_filter([CASE WHEN NOT long THEN 'text_too_short' END, CASE WHEN long AND score < 30 AND NOT email AND NOT phone THEN 'missing_contact_info' END,
  CASE WHEN long AND score < 30 AND experience = 0 THEN 'no_experience_indicators' END, CASE WHEN long AND score < 30 AND education = 0 THEN 'no_education_indicators' END, CASE WHEN long AND score < 30 AND other > 0 THEN 'contains_non_resume_content' END], lambda x: x IS NOT NULL) AS reasons FROM s""")
def invalid_routing(spark: SparkSession, d: str) -> DataFrame:
    checked = C.with_validity(table(spark, d, "documents"), "text")
    return checked.select("doc_id", F.when(F.col("is_valid"), "pending").otherwise("failed").alias("status"), "reasons")


@_query(r"SELECT doc_id, length(trim(coalesce(text, ''))) < 100 OR len(regexp_extract_all(coalesce(text, ''), '\S+')) < 20 AS scanned FROM documents")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.scanned(F.col("text")).alias("scanned"))


_PHONE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in L.PHONES) + ")"


@_query(rf"SELECT doc_id, nullif(regexp_extract(text, '{L.EMAIL}'), '') AS email, {_PHONE_SQL} AS phone, CASE WHEN length(regexp_replace({_PHONE_SQL}, '[^\d+]', '', 'g')) >= 10 THEN regexp_replace({_PHONE_SQL}, '[^\d+]', '', 'g') END AS digits FROM documents")
def contact_extraction(spark: SparkSession, d: str) -> DataFrame:
    phone = C.first_phone(F.col("text"))
    return table(spark, d, "documents").select("doc_id", C.first_email(F.col("text")).alias("email"), phone.alias("phone"), C.phone_digits(phone).alias("digits"))


@_query(r"""SELECT page_id, CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN regexp_matches(lower(url), 'gmail\.|yahoo\.|outlook\.|hotmail\.') THEN 'mail'
  WHEN regexp_matches(lower(url), 'portfolio|blog|behance|dribbble|\.dev|\.me') THEN 'portfolio' ELSE 'other' END AS kind,
  CASE WHEN trim(bare) = '' OR lower(trim(bare)) = 'unknown' THEN NULL ELSE 'https://' || trim(bare) END AS normal FROM (SELECT *, regexp_replace(url, '^https?://', '') AS bare FROM pages)""")
def link_classification(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each page's url, and its address without scheme normalised again."""
    return table(spark, d, "pages").select("page_id", C.link_kind(F.col("url")).alias("kind"), C.normalize_url(F.regexp_replace("url", "^https?://", "")).alias("normal"))


_WORDS = ["the", "that", "and", "license", "copyright", "contact", "phone", "email", "sur", "und", "para"]


@_query(f"SELECT doc_id, list_filter([{', '.join(repr(w) for w in _WORDS)}], lambda w: contains(lower(coalesce(text, '')), w)) AS mentions FROM documents")
def keyword_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.skills_in(F.coalesce("text", F.lit("")), _WORDS).alias("mentions"))


@_query(f"""WITH m AS (SELECT doc_id, unnest(list_filter([{', '.join(repr(w) for w in _WORDS + ['contacts', 'emails', 'phones', 'parade'])}], lambda w: contains(lower(coalesce(text, '')), w))) AS term FROM documents)
SELECT DISTINCT doc_id, term FROM m AS a WHERE NOT EXISTS (SELECT 1 FROM m AS b WHERE a.doc_id = b.doc_id AND a.term <> b.term AND contains(a.term, b.term))""")
def term_fold(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(C.skills_in(F.coalesce("text", F.lit("")), [*_WORDS, "contacts", "emails", "phones", "parade"])).alias("term"))
    return upserts.fold_terms(found, "doc_id", "term")


_QUALITY_SQL = """WITH c AS (SELECT doc_id, n_chars, len(list_distinct(string_split(coalesce(text, ''), ' '))) % 12 AS k, n_chars % 9 AS y, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
q AS (SELECT doc_id, least(100, greatest(0, CASE WHEN k >= 10 THEN 20 WHEN k >= 5 THEN 15 WHEN k >= 3 THEN 10 WHEN k >= 1 THEN 5 ELSE 0 END + CASE WHEN y >= 1 THEN 20 ELSE 0 END + CASE WHEN n >= 3 THEN 20 WHEN n >= 2 THEN 15 WHEN n >= 1 THEN 10 ELSE 0 END
  + CASE WHEN y >= 2 THEN 15 WHEN y >= 1 THEN 10 ELSE 0 END + CASE WHEN k >= 2 THEN 10 WHEN k >= 1 THEN 5 ELSE 0 END + CASE WHEN n_chars > 500 THEN 10 WHEN n_chars > 200 THEN 5 ELSE 0 END + CASE WHEN k >= 3 THEN 5 ELSE 0 END + CASE WHEN y >= 4 THEN 15 ELSE 8 END - CASE WHEN y = 0 THEN 20 ELSE 0 END)) AS score FROM c)"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a document stand in for the parts of a parsed résumé."""
    text = F.coalesce("text", F.lit(""))
    k, y, n = F.size(F.array_distinct(F.split(text, " "))) % 12, F.col("n_chars") % 9, F.size(F.split(text, "\n"))
    score = C.parse_quality(k, y, n, y, k, F.col("n_chars"), k, F.when(y >= 4, 0.9).otherwise(0.6), y == 0)
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@_query(f"{_QUALITY_SQL} SELECT doc_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 50 THEN 'moderate' ELSE 'low' END AS tier, score >= 80 AS may_match, score < 80 AS reprocess FROM q")
def parse_quality_score(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return _quality(spark, d).select("doc_id", "score", C.quality_tier(s).alias("tier"), C.may_match(s).alias("may_match"), (s.isNull() | (s < 80)).alias("reprocess"))


_POST = """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Senior ' WHEN 'system' THEN 'Mid-level ' ELSE '' END || text || chr(10) || 'Location: City ' || conv_id || chr(10) || CASE turn % 3 WHEN 0 THEN 'at least ' || (turn + 2) || ' years, remote, full-time, python and sql' WHEN 1 THEN (turn + 20) || ' years of experience in an office, contract' ELSE 'PhD, internship' END AS text FROM conversations)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Turns dressed as job posts: a title word, the turn, a location and a line of demands."""
    title = F.when(F.col("role") == "user", "Senior ").when(F.col("role") == "system", "Mid-level ").otherwise("")
    demand = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("at least "), F.col("turn") + 2, F.lit(" years, remote, full-time, python and sql"))).when(F.col("turn") % 3 == 1, F.concat(F.col("turn") + 20, F.lit(" years of experience in an office, contract"))).otherwise("PhD, internship")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(title, "text", F.lit("\nLocation: City "), "conv_id", F.lit("\n"), demand).alias("text"))


def _first_years_sql() -> str:
    return "coalesce(" + ", ".join(f"list_filter(list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 20)[1]" for p in L.YEARS_PATTERNS) + ")"


def _any_of_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _contains_any(words: list[str]) -> str:
    return _any_of_sql("low", words)


@_query(f"""{_POST}, p AS (SELECT *, lower(text) AS low, {_first_years_sql()} AS years FROM t),
l AS (SELECT *, regexp_extract(low, '^({'|'.join(L.SENIORITY_TITLES)})', 1) AS title FROM p)
SELECT conv_id, turn, years, coalesce(CASE {' '.join(f"WHEN title IN ({', '.join(repr(x) for x in ws)}) THEN '{k}'" for k, ws in L.SENIORITY_WORDS.items())} END, CASE {' '.join(f"WHEN {_contains_any(ws)} THEN '{k}'" for k, ws in L.SENIORITY_WORDS.items())} END,
    CASE WHEN years >= 7 THEN 'senior' WHEN years >= 4 THEN 'mid' WHEN years >= 1 THEN 'junior' END) AS seniority,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END" for k, p in L.EDUCATION_PATTERNS.items())}], lambda x: x IS NOT NULL) AS education,
  trim(coalesce({', '.join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in L.LOCATION_PATTERNS)})) AS location, {_contains_any(L.REMOTE)} AND NOT {_contains_any(L.ON_SITE)} AS remote_allowed,
  CASE WHEN contains(low, 'full-time') OR contains(low, 'full time') THEN 'full-time' WHEN contains(low, 'part-time') OR contains(low, 'part time') THEN 'part-time' WHEN contains(low, 'contract') THEN 'contract' WHEN contains(low, 'intern') THEN 'internship' END AS employment_type,
  list_filter([{', '.join(repr(w) for w in L.JOB_SKILLS)}], lambda w: contains(low, w)) AS skills FROM l""")
def job_post_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _posts(spark, d).select("conv_id", "turn", C.stated_years(t).alias("years"), C.post_seniority(t).alias("seniority"), C.education_flags(t).alias("education"), C.job_location(t).alias("location"), C.remote_allowed(t).alias("remote_allowed"), C.employment_type(t).alias("employment_type"), C.skills_in(t).alias("skills"))


@_query("SELECT text_hash, n, n_chars FROM (SELECT sha256(coalesce(text, '')) AS text_hash, count(*) AS n, min(length(coalesce(text, ''))) AS n_chars FROM documents GROUP BY 1)")
def embed_once(spark: SparkSession, d: str) -> DataFrame:
    """Something dear is computed once for each distinct text and joined back; here, counts by text hash."""
    rows = upserts.once_per_text(table(spark, d, "documents").select("doc_id", "text"), "text", lambda t: t.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    return rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("n_chars"))


# --- versions, upserts, deduplication -----------------------------------------------------------------------


@_query("SELECT o_custkey AS resume_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + coalesce(b.top, 0) AS INTEGER) AS version_number FROM orders LEFT JOIN (SELECT c_custkey, max(c_nationkey % 3) AS top FROM customer GROUP BY c_custkey) AS b ON c_custkey = o_custkey")
def version_next(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("resume_id"), "o_orderkey", "o_orderdate")
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("resume_id"), (F.col("c_nationkey") % 3).alias("version_number"))
    return upserts.number_versions(new, old, "resume_id", "version_number", ["o_orderdate", "o_orderkey"]).select("resume_id", "o_orderkey", "version_number")


@_query("SELECT c_custkey AS resume_id, o.o_orderkey, o.v AS version_number FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) AS o ON o.o_custkey = c_custkey AND back = 1")
def version_current(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    v = upserts.number_versions(o, o.filter("false").select("o_custkey", F.lit(0).alias("version_number")), "o_custkey", "version_number", ["o_orderdate", "o_orderkey"])
    now = upserts.flag_current(v, "o_custkey", "version_number").filter("is_current")
    return table(spark, d, "customer").join(now, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("resume_id"), "o_orderkey", "version_number")


@_query("""WITH p AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 10000000 END AS c_custkey, s_name AS c_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS c_acctbal FROM supplier)
SELECT coalesce(b.c_custkey, p.c_custkey) AS c_custkey, coalesce(p.c_name, b.c_name) AS c_name, coalesce(p.c_acctbal, b.c_acctbal) AS c_acctbal FROM customer AS b FULL JOIN p ON p.c_custkey = b.c_custkey""")
def candidate_upsert(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("c_acctbal"))
    return upserts.upsert(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), patch, ["c_custkey"])


@_query("""WITH b AS (SELECT l_orderkey AS candidate_id, l_partkey AS job_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_orderkey AS candidate_id, l_suppkey AS job_id, arg_max(l_tax, row(l_shipdate, l_linenumber, l_tax, l_partkey)) AS score FROM lineitem GROUP BY 1, 2)
SELECT coalesce(b.candidate_id, p.candidate_id) AS candidate_id, coalesce(b.job_id, p.job_id) AS job_id, coalesce(p.score, b.score) AS score FROM b FULL JOIN p ON b.candidate_id = p.candidate_id AND b.job_id = p.job_id""")
def match_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pair scores, the last write of each pair wins."""
    line = table(spark, d, "lineitem")
    base = line.groupBy(F.col("l_orderkey").alias("candidate_id"), F.col("l_partkey").alias("job_id")).agg(F.max("l_quantity").alias("score"))
    writes = line.select(F.col("l_orderkey").alias("candidate_id"), F.col("l_suppkey").alias("job_id"), F.col("l_tax").alias("score"), F.struct("l_shipdate", "l_linenumber", "l_tax", "l_partkey").alias("at"))
    return upserts.upsert(base, upserts.latest_patch(writes, ["candidate_id", "job_id"], "at").drop("at"), ["candidate_id", "job_id"])


@_query("SELECT s_suppkey, s_name, g.k IS NOT NULL AS is_archived, g.k IS NULL AS is_active FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount >= 0.1) AS g ON g.k = s_suppkey")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").filter("l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return upserts.soft_delete(table(spark, d, "supplier").select("s_suppkey", "s_name"), gone, "s_suppkey")


@_query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM g))
SELECT 'customer' AS name, count(*) AS kept FROM customer WHERE c_custkey NOT IN (FROM g) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (FROM o) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM o)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    c, o, line = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    gone = c.filter("c_acctbal < 0")
    gone_orders = o.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    kept = [("customer", c.join(gone.select("c_custkey"), "c_custkey", "left_anti")), ("orders", upserts.cascade(gone, "c_custkey", [(o, "o_custkey")])[0]), ("lineitem", upserts.cascade(gone_orders, "o_orderkey", [(line, "l_orderkey")])[0])]
    out = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("name"), "kept") for name, df in kept]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20")
def active_jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 100; the limit is the feature."""
    return page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 100, o_orderstatus="O", o_orderpriority=None).select("o_orderkey", "o_orderdate", "o_totalprice")


@_query("SELECT o_custkey, o_orderpriority, min(row(o_orderdate, o_orderkey)).o_orderkey AS o_orderkey FROM orders GROUP BY 1, 2".replace("min(row(o_orderdate, o_orderkey)).o_orderkey", "arg_min(o_orderkey, row(o_orderdate, o_orderkey))"))
def dedup_entries(spark: SparkSession, d: str) -> DataFrame:
    return upserts.dedup_entries(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@_query("SELECT o_custkey, o_orderstatus, arg_min(p, o_orderkey) FILTER (WHERE p IS NOT NULL) AS price, arg_min(q, o_orderkey) FILTER (WHERE q IS NOT NULL) AS priority FROM (SELECT *, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS p, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS q FROM orders) GROUP BY 1, 2")
def merge_entries(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))
    return upserts.merge_entries(o, ["o_custkey", "o_orderstatus"], ["price", "priority"], "o_orderkey")


@_query("""WITH a AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS candidate_id, list_sort(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))) AS skills, coalesce(a.n, b.n) AS entries FROM a FULL JOIN b ON a.k = b.k""")
def merge_parses(spark: SparkSession, d: str) -> DataFrame:
    """Open orders as one parse and all others as another: skills united, entries from the second only where the first has none."""
    def parsed(orders: DataFrame) -> DataFrame:
        return orders.groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.collect_set("o_orderpriority").alias("skills"), F.count(F.lit(1)).alias("entries"))

    o = table(spark, d, "orders")
    return upserts.merge_parses(parsed(o.filter("o_orderstatus = 'O'")), parsed(o.filter("o_orderstatus <> 'O'")), "candidate_id", "skills", "entries")


# --- lines --------------------------------------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS t(i))"
_HEADS = {"opening": r"^(the|de|der|el|le|la)[ ,.]", "list": r"\|", "loud": r"!!"}
_MARKED = f"""{_LINES}, h AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(lower(trim(line)), '{p}') THEN '{k}'" for k, p in _HEADS.items())} END AS h FROM lines),
marked AS (SELECT doc_id, line_no, line, CASE WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, h ORDER BY line_no) = 1 THEN h END AS section FROM h)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.to_lines(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return lines.section_headers(_lines(spark, d), "doc_id", _HEADS)


@_query(f"WITH {_MARKED} SELECT doc_id, line_no, section FROM marked WHERE section IS NOT NULL")
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter("section IS NOT NULL").select("doc_id", "line_no", "section")


@_query(f'WITH {_MARKED}, z AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS z FROM marked) SELECT doc_id, section, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, z) AS "end" FROM z WHERE section IS NOT NULL')
def section_bounds(spark: SparkSession, d: str) -> DataFrame:
    return lines.section_bounds(_marked(spark, d), "doc_id")


@_query(f"WITH {_MARKED} SELECT doc_id, line_no, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS label FROM marked")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return lines.carry_forward(_marked(spark, d), "doc_id").select("doc_id", "line_no", "label")


@_query(f"""WITH {_LINES}, f AS (SELECT *, max(contains(line, ',')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM lines),
r AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM f WHERE near = 1), s AS (SELECT doc_id, min(line_no) AS start, max(line_no) AS stop FROM r GROUP BY doc_id, r)
SELECT doc_id, start, stop AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start - stop, start) AS b FROM s) WHERE b = 1""")
def neighbourhood_runs(spark: SparkSession, d: str) -> DataFrame:
    return lines.longest_run(_lines(spark, d), "doc_id", F.contains(F.col("line"), F.lit(",")))


@_query(f"""WITH RECURSIVE {_LINES}, hits AS (SELECT doc_id, line_no FROM lines WHERE contains(line, '|')),
tested AS (SELECT doc_id, min(line_no) AS line_no FROM hits GROUP BY doc_id UNION ALL SELECT t.doc_id, min(h.line_no) FROM tested AS t JOIN hits AS h ON h.doc_id = t.doc_id AND h.line_no > t.line_no + 2 GROUP BY t.doc_id, t.line_no)
SELECT doc_id, line_no FROM lines AS l WHERE NOT EXISTS (SELECT 1 FROM tested AS t WHERE t.doc_id = l.doc_id AND l.line_no BETWEEN t.line_no AND t.line_no + 2)""")
def suppress_forward(spark: SparkSession, d: str) -> DataFrame:
    return lines.suppress_forward(_lines(spark, d), "doc_id", F.contains(F.col("line"), F.lit("|"))).select("doc_id", "line_no")


@_query(f"WITH {_LINES} SELECT doc_id, line_no, contains(line, ',') AND sum(contains(line, ',')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - contains(line, ',')::INTEGER >= 2 AS consistent FROM lines")
def separator_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.consistent_separator(_lines(spark, d), "doc_id", F.contains(F.col("line"), F.lit(","))).select("doc_id", "line_no", "consistent")


@_query(f"""WITH {_LINES}, o AS (SELECT *, ends_with(line, '.') AND length(line) < 120 AS o FROM lines), s AS (SELECT *, NOT o AND coalesce(lead(o) OVER w, false) AS p, o OR coalesce(lead(o) OVER w, false) AND NOT o AS f FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, f AND NOT (o AND coalesce(lag(p) OVER w, false)) AS first FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), e AS (SELECT *, sum(first::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS entry_id FROM g)
SELECT doc_id, entry_id, min(line_no) AS start, count(*) AS n_lines, arg_min(line, line_no) AS head FROM e WHERE entry_id > 0 GROUP BY doc_id, entry_id""")
def entry_split(spark: SparkSession, d: str) -> DataFrame:
    """Entries opened by short closing lines, each with the line before it."""
    return lines.split_entries(_lines(spark, d), "doc_id", F.col("line").endswith(".") & (F.length("line") < 120))


# --- events -------------------------------------------------------------------------------------------------


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def status_progress(spark: SparkSession, d: str) -> DataFrame:
    return ingest.progress(table(spark, d, "events"), "ts", "event_type")


@_query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def request_rate_violations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rate_violations(table(spark, d, "events"), "user_id", "ts", "1 hour", 1)


@_query("SELECT event_id, min(ts) AS ts FROM (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts FROM events WHERE value > 50) GROUP BY event_id")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    again = table(spark, d, "events").filter("value > 50").select("event_id", "ts")
    return ingest.drop_repeats_of_table(e.unionByName(again), "event_id", "ts")


@_query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.status_latest(table(spark, d, "events"), "user_id", "ts", "event_type")


@_query("SELECT user_id, count(*) AS failures, CASE WHEN count(*) >= 3 THEN 'dead_letter' ELSE 'retry' END AS route FROM events WHERE event_type = 'error' GROUP BY user_id")
def dead_letter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.attempts(table(spark, d, "events"), "user_id", F.col("event_type") == "error", 3)


@_query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")
