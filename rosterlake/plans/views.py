"""Stand-in views of the matching domain over the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def candidate_skills(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, skill), distinct."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    owned = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    # Distinct part keys first: names are attached to far fewer rows.
    pairs = owned.select("o_custkey", "l_partkey").distinct()
    return pairs.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("candidate_id"), F.col("p_name").alias("skill")).distinct()


def job_skills(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, skill, rn, kind): the five most frequent part names of a supplier are required, the next three nice."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("c"))
    named = lines.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_name").agg(F.sum("c").alias("c"))
    ranked = named.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("c"), "p_name"))).filter("rn <= 8")
    return ranked.select(F.col("l_suppkey").alias("job_id"), F.col("p_name").alias("skill"), "rn", F.when(F.col("rn") <= 5, "required").otherwise("nice").alias("kind"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, n_required, n_nice, years)."""
    return jobs_of(job_skills(spark, d))


def jobs_of(asked: DataFrame) -> DataFrame:
    """jobs, of job_skills."""
    counts = asked.groupBy("job_id").agg(F.count(F.when(F.col("kind") == "required", 1)).alias("n_required"), F.count(F.when(F.col("kind") == "nice", 1)).alias("n_nice"))
    return counts.withColumn("years", F.pmod("job_id", F.lit(8)).cast("int"))


def experience(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, start, end): an order's date and 30 days for each line number after it."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"), F.to_date("o_orderdate").alias("start"))
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("n"))
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("candidate_id", "start", F.date_add("start", F.col("n") * 30).alias("end"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, project, text): a candidate's last five orders with the part names of their lines."""
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).filter("rn <= 5")
    named = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]), " ")
    return named.groupBy(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("project")).agg(text.alias("text"))


def vectors(spark: SparkSession, d: str, key: str) -> DataFrame:
    """(key, vector): the vector whose vec_id is the candidate's or job's id stands for its text."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vector"))


def stored_matches(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, job_id), distinct: a candidate and a supplier of one of its orders count as matched before."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("job_id"))
    return table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("candidate_id"), "job_id").distinct()


CANDIDATE_SKILLS = "candidate_skills AS (SELECT DISTINCT o_custkey AS candidate_id, p_name AS skill FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"
JOB_SKILLS = """job_skills AS (SELECT job_id, skill, rn, CASE WHEN rn <= 5 THEN 'required' ELSE 'nice' END AS kind FROM (
  SELECT l_suppkey AS job_id, p_name AS skill, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) AS rn FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_name) WHERE rn <= 8)"""
JOBS = "jobs AS (SELECT job_id, count(*) FILTER (WHERE kind = 'required') AS n_required, count(*) FILTER (WHERE kind = 'nice') AS n_nice, CAST(job_id % 8 AS INTEGER) AS years FROM job_skills GROUP BY job_id)"
EXPERIENCE = "experience AS (SELECT o_custkey AS candidate_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) * 30 AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
TENURE = """ranked AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM experience),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM ranked),
merged AS (SELECT candidate_id, i, min(s) AS s, max(e) AS e FROM islands GROUP BY candidate_id, i),
tenure AS (SELECT candidate_id, CAST(sum(e - s) AS BIGINT) AS days, CAST(floor(sum(e - s) / 365.25::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS years FROM merged GROUP BY candidate_id)"""
PROJECT_SCORES = """last_five AS (SELECT * FROM (SELECT o_custkey AS candidate_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5),
project_texts AS (SELECT candidate_id, o_orderkey, lower(string_agg(p_name, ' ' ORDER BY l_linenumber, p_name)) AS text FROM last_five JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY candidate_id, o_orderkey),
job_words AS (SELECT job_id, list(DISTINCT lower(skill)) AS words FROM job_skills GROUP BY job_id),
project_scores AS (SELECT candidate_id, job_id, round(count(*) FILTER (WHERE len(list_filter(words, lambda w: contains(text, w))) >= 2) * 100.0::DOUBLE / count(*), 2) AS project_score FROM project_texts CROSS JOIN job_words GROUP BY candidate_id, job_id)"""
DOMAIN_SCORES = """domain_scores AS (SELECT a.vec_id AS candidate_id, job_id, round((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) * 50, 2) AS domain_score FROM embeddings AS a CROSS JOIN jobs JOIN embeddings AS b ON b.vec_id = job_id)"""
BASE = ", ".join([CANDIDATE_SKILLS, JOB_SKILLS, JOBS])
