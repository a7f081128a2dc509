"""Registered queries over profiles, replies, caches and snapshots, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import _RANKED_SQL, _any_of_sql, _profiles, _query, _top
from .catalogue_resumes import _LINKS_SQL
from .functions import columns as C
from .functions import lexicons as L
from .functions import profiles as P
from .functions import resumes as T
from .operators import intervals, lines, ranking, upserts
from .operators import resumes as R
from .plans import resumes as V
from .plans import views
from .sources.tables import by_key, table
from .streaming import ingest

# --- profiles -----------------------------------------------------------------------------------------------

#: Two parses of each customer as JSON fields, plain expressions that both engines read; the first finds nothing for a third of them.
_PARSE = {
    "one_name": "CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_name || ' Doe' END", "one_sure": "CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE (c_custkey % 10) / 10.0 END",
    "one_work": "CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '[\"a\",\"b\"]' END", "one_front": "CASE WHEN c_custkey % 3 = 0 THEN '[]' WHEN c_custkey % 2 = 0 THEN '[\"React\",\"' || c_mktsegment || '\"]' ELSE 'Vue' END",
    "two_name": "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END", "two_sure": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 0.57 END", "two_work": "'oops'", "two_front": "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '[\"Go\"]' END",
}


@_query("""WITH p AS (SELECT c_custkey, c_name, c_custkey % 3 <> 0 AS one, c_custkey % 9 <> 0 AS two, c_mktsegment FROM customer)
SELECT c_custkey AS candidate_id, CASE WHEN one THEN 'profile' WHEN two THEN 'rules' ELSE 'none' END AS parser, CASE WHEN one OR two THEN c_name ELSE 'unknown' END AS first_name, CASE WHEN one THEN 'Doe' ELSE 'unknown' END AS last_name,
  CASE WHEN one THEN (c_custkey % 10) * 10 WHEN two THEN 57 ELSE 0 END::INTEGER AS quality, CASE WHEN one AND c_custkey % 2 = 0 THEN ['React', c_mktsegment] WHEN one THEN ['Vue'] WHEN two THEN ['Go'] ELSE [] END AS skills, CASE WHEN one THEN 2 ELSE 0 END AS entries FROM p""")
def parser_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first parse that found anything, as a stored record: name split, percent, skills as one list, what is no list an empty one."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS candidate_id", *[f"{e} AS {n}" for n, e in _PARSE.items()])
    parses = {}
    for way, prefix in (("profile", "one"), ("rules", "two")):
        name, sure, work, skills = F.col(f"{prefix}_name"), F.col(f"{prefix}_sure").cast("double"), P.strictly_listed(F.col(f"{prefix}_work")), P.listed(F.col(f"{prefix}_front"))
        first, last = C.split_name(F.when(F.lower(name) != "unknown", name))
        parses[way] = F.when(P.usable(name, sure, work, skills), F.struct(F.lit(way).alias("parser"), first.alias("first_name"), last.alias("last_name"), P.percent(sure).alias("quality"), skills.alias("skills"), F.size(work).alias("entries")))
    none = F.struct(F.lit("none").alias("parser"), F.lit("unknown").alias("first_name"), F.lit("unknown").alias("last_name"), F.lit(0).alias("quality"), F.array().cast("array<string>").alias("skills"), F.lit(0).alias("entries"))
    return c.select("candidate_id", F.coalesce(*parses.values(), none).alias("r")).select("candidate_id", "r.*")


@_query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rejected' ELSE 'new' END AS status FROM customer), o AS (SELECT o_custkey, max(o_orderkey) AS resume_id FROM orders GROUP BY 1)
SELECT c_custkey AS candidate_id, status, resume_id FROM c LEFT JOIN o ON o_custkey = c_custkey WHERE status <> 'rejected'""")
def open_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates not rejected, with their latest résumé; a status that is not known is neither and drops out."""
    status = F.when(F.col("c_custkey") % 4 == 1, "rejected").when(F.col("c_custkey") % 4 > 1, "new")
    latest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.max("o_orderkey").alias("resume_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), status.alias("status")).filter("status <> 'rejected'")
    return c.join(latest, "candidate_id", "left")


@_query("""SELECT c_custkey AS candidate_id, list_distinct_ordered AS flags FROM (SELECT c_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment, 'gap'] ELSE [] END || CASE WHEN c_custkey % 3 = 0 THEN ['gap', 'hops', c_mktsegment] ELSE [] END AS l FROM customer))""")
def merged_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of two sources, each once, the first source's first."""
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(k.alias("candidate_id"), P.merge_flags(F.when(k % 2 == 0, F.array(m, F.lit("gap"))), F.when(k % 3 == 0, F.array(F.lit("gap"), F.lit("hops"), m))).alias("flags"))


@_query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN role ELSE repeat('x', 250 + CAST(conv_id % 10 AS INT)) END AS title, text, CASE WHEN turn % 2 = 0 THEN role || '@x.example' WHEN turn = 1 THEN 'a@b@c.d' END AS email FROM conversations)
SELECT conv_id, turn, list_filter([CASE WHEN NOT coalesce(length(title) BETWEEN 1 AND 255, false) THEN 'title' END, CASE WHEN NOT coalesce(length(text) >= 50, false) THEN 'text' END, CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' END], lambda x: x IS NOT NULL) AS violations FROM t""")
def post_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a post out: title, text or e-mail; an empty list lets it in."""
    turn = F.col("turn")
    title = F.when(turn % 3 == 0, "").when(turn % 3 == 1, F.col("role")).otherwise(F.repeat(F.lit("x"), (F.col("conv_id") % 10 + 250).cast("int")))
    email = F.when(turn % 2 == 0, F.concat("role", F.lit("@x.example"))).when(turn == 1, "a@b@c.d")
    return table(spark, d, "conversations").select("conv_id", "turn", P.violations(title, F.col("text"), email).alias("violations"))


@_query(f"""WITH {views.EXPERIENCE}, {views.TENURE}, c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'senior' END AS level, CASE c_custkey % 3 WHEN 0 THEN 'Team Lead' WHEN 1 THEN 'Clerk' ELSE 'VP Sales' END AS title FROM customer)
SELECT c_custkey AS candidate_id, CASE WHEN level <> 'unknown' THEN level WHEN years IS NULL THEN 'mid' WHEN {_any_of_sql("lower(title)", L.LEADERSHIP_INFERRED)} AND years >= 10 THEN 'principal' WHEN {_any_of_sql("lower(title)", L.LEADERSHIP_INFERRED)} AND years >= 8 THEN 'lead'
  WHEN years = 0 THEN 'intern' WHEN years < 2 THEN 'junior' WHEN years < 5 THEN 'mid' WHEN years < 8 THEN 'senior' WHEN years < 12 THEN 'lead' ELSE 'principal' END AS level, CASE WHEN level <> 'unknown' THEN NULL WHEN years IS NULL THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM c LEFT JOIN tenure ON candidate_id = c_custkey""")
def seniority_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Levels inferred only where they are unknown: 0.7 sure by years and titles, mid and 0.5 where there are no years."""
    years = intervals.tenure(views.experience(spark, d), "candidate_id", "start", "end").select("candidate_id", "years")
    k = F.col("candidate_id")
    title = F.when(k % 3 == 0, "Team Lead").when(k % 3 == 1, "Clerk").otherwise("VP Sales")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id")).join(years, "candidate_id", "left")
    unknown = k % 2 == 0
    return c.select(k, F.when(unknown, P.inferred_seniority(F.col("years"), title)).otherwise("senior").alias("level"), F.when(unknown, F.when(F.col("years").isNull(), 0.5).otherwise(0.7)).alias("confidence"))


@_query(f"""WITH {_LINKS_SQL}, l AS (SELECT candidate_id, arg_min(url, place) AS own FROM links WHERE kind = 'github' GROUP BY 1)
SELECT r.candidate_id, coalesce(CASE WHEN r.candidate_id % 2 = 0 THEN c_name END, 'c' || r.candidate_id || '@gmail.com') AS name, coalesce(CASE WHEN r.candidate_id % 5 = 0 THEN 'x@y.example' END, nullif(regexp_extract(text, '{L.EMAIL}'), '')) AS email, own AS github FROM resumes AS r JOIN customer ON c_custkey = r.candidate_id LEFT JOIN l USING (candidate_id)""")
def filled_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Stored profiles whose unknown name, e-mail and link come from the text."""
    k = F.col("candidate_id")
    found = V.resumes(spark, d).select(k, C.first_email(F.col("text")).alias("found"), F.nullif(F.regexp_extract("text", r"github\.com/[a-zA-Z0-9_-]+", 0), F.lit("")).alias("link"))
    both = found.join(table(spark, d, "customer").withColumnRenamed("c_custkey", "candidate_id"), "candidate_id")
    name, email = F.when(k % 2 == 0, F.col("c_name")).otherwise("unknown"), F.when(k % 5 == 0, "x@y.example").otherwise("unknown")
    return both.select(k, T.filled(name, F.col("found")).alias("name"), T.filled(email, F.col("found")).alias("email"), C.normalize_url(F.col("link")).alias("github"))


# --- replies and prompts ------------------------------------------------------------------------------------

_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Sure {not this} ' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'or {\"k\": 1}' WHEN 1 THEN 'The answer: ' || props || ' as asked' WHEN 2 THEN 'none' ELSE '{broken ' || event_type END"


@_query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) ELSE 50.0::DOUBLE END AS score, event_id % 4 < 2 AS parsed FROM events""")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Scores from free-text replies: a fenced block before any other braces, 50 where there is no JSON."""
    got = table(spark, d, "events").select("event_id", F.from_json(P.reply_json(F.expr(_REPLY)), "k double", {"mode": "PERMISSIVE"})["k"].alias("k"))
    return got.select("event_id", F.coalesce("k", F.lit(50.0)).alias("score"), F.col("k").isNotNull().alias("parsed"))


@_query(f"""WITH {V.RESUME_LINES}, k AS (SELECT candidate_id, min(line_no) AS k FROM resume_lines WHERE contains(lower(line), 'experience') GROUP BY 1),
i AS (SELECT candidate_id, trim(regexp_replace(trim(line), '^[-•]+', '')) AS item, row_number() OVER (PARTITION BY candidate_id ORDER BY line_no) AS rn FROM resume_lines JOIN k USING (candidate_id) WHERE line_no > k AND trim(line) <> '' AND NOT contains(lower(line), 'experience'))
SELECT candidate_id, list(item ORDER BY rn) AS items FROM i WHERE rn <= 5 GROUP BY 1""")
def reply_lists(spark: SparkSession, d: str) -> DataFrame:
    """The five lines, bullets or not, that follow a keyword in a free text."""
    return lines.listed_after(V.resumes(spark, d), "candidate_id", "text", "experience", 5)


@_query(f"""WITH {views.JOB_SKILLS}, s AS (SELECT job_id, list(skill ORDER BY rn) FILTER (WHERE kind = 'required') AS r, list(skill ORDER BY rn) FILTER (WHERE kind = 'nice') AS n FROM job_skills GROUP BY 1)
SELECT job_id, 'Job ' || s_name || ' asks for: ' || array_to_string(r[1:10], ', ') || '. Nice to have: ' || CASE WHEN len(n) > 0 THEN array_to_string(n[1:10], ', ') ELSE 'none' END || '. Years: ' || job_id % 8 || '. Reply with JSON.' AS prompt FROM s JOIN supplier ON s_suppkey = job_id""")
def match_prompts(spark: SparkSession, d: str) -> DataFrame:
    """One prompt a job."""
    asked = ranking.job_profiles(views.job_skills(spark, d), views.jobs(spark, d).select("job_id", "years"), views.vectors(spark, d, "job_id"))
    named = asked.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("job_id"))
    return named.select("job_id", P.match_prompt(F.col("s_name"), F.col("required"), F.col("nice"), F.col("years")).alias("prompt"))


@_query(f"""WITH {_RANKED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY overall DESC, job_id) AS rn FROM o), f AS (SELECT *, CASE WHEN (candidate_id + job_id) % 4 <> 0 THEN skill_score END AS refined FROM t WHERE rn <= 3)
SELECT candidate_id, coalesce(arg_max(job_id, row(refined, -rn)) FILTER (WHERE refined IS NOT NULL), arg_min(job_id, rn)) AS job_id FROM f GROUP BY 1""")
def refined_best_job(spark: SparkSession, d: str) -> DataFrame:
    """The best of a candidate's three best jobs by a dearer score, which some lack; the first where all do."""
    top = _top(*_profiles(spark, d), "candidate", 3)
    refined = top.withColumn("refined", F.when((F.col("candidate_id") + F.col("job_id")) % 4 != 0, F.col("skill_score")))
    return ranking.best_refined(refined, "candidate_id", "job_id", "refined")


# --- dates and lists ----------------------------------------------------------------------------------------


@_query("""WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN d WHEN 2 THEN make_date(year(d), 1, 1) WHEN 6 THEN DATE '2024-05-06' ELSE CAST(date_trunc('month', d) AS DATE) END AS parsed, CASE k WHEN 2 THEN make_date(year(d), 12, 31) WHEN 1 THEN d WHEN 6 THEN DATE '2024-05-06' ELSE CAST(date_trunc('month', d) AS DATE) END AS ended,
  CASE k WHEN 2 THEN CAST(year(d) AS VARCHAR) WHEN 6 THEN 'present' ELSE strftime(d, '%Y-%m') END AS normal FROM t""")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in seven ways and read again."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 7
    ways = ["yyyy-MM", "yyyy-MM-dd", "yyyy", "MMM yyyy", "MMMM yyyy", "M/yyyy"]
    text = F.coalesce(*[F.when(k == i, F.date_format(day, w)) for i, w in enumerate(ways)], F.lit("Present"))
    now = F.lit("2024-05-06").cast("date")
    return table(spark, d, "orders").select("o_orderkey", C.parse_date(text, now).alias("parsed"), C.parse_date(text, now, year_end=True).alias("ended"), C.normalize_date(text, now).alias("normal"))


@_query("""WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, p_name AS n, p_type AS t FROM part)
SELECT p_partkey, CASE WHEN k = 4 THEN [n || chr(10) || ''] ELSE [n, t, 'x2'] END AS skills, CASE WHEN k = 4 THEN [false] ELSE [false, false, true] END AS technical FROM t""".replace("[n || chr(10) || '']", "[n, t]").replace("[false] ELSE", "[false, false] ELSE"))
def skill_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of skills written with commas, semicolons, "and", bullets or lines, split, with whether each item looks technical."""
    k, n, t = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    text = F.when(k == 0, F.concat(n, F.lit(", "), t, F.lit(", x2"))).when(k == 1, F.concat(n, F.lit("; "), t, F.lit(";x2;y"))).when(k == 2, F.concat(n, F.lit(" and "), t, F.lit(" AND x2"))).when(k == 3, F.concat(F.lit("• "), n, F.lit(" • "), t, F.lit("• x2"))).otherwise(F.concat(n, F.lit("\n"), t))
    split = table(spark, d, "part").select("p_partkey", C.split_skills(text).alias("skills"))
    return split.withColumn("technical", F.transform("skills", lambda x: C.looks_technical(x)))


@_query(f"""WITH {V.RESUME_LINES}, g AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY candidate_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM resume_lines)
SELECT candidate_id, g AS entry_no, arg_min(trim(line), line_no) FILTER (WHERE regexp_matches(line, '{L.ENTRY_TITLE}')) AS title, arg_min(trim(line), line_no) FILTER (WHERE regexp_matches(line, '{L.ENTRY_COMPANY}')) AS company, arg_min(trim(line), line_no) FILTER (WHERE regexp_matches(line, '{L.ENTRY_RANGE}')) AS dates FROM g GROUP BY 1, 2
HAVING coalesce(title, company, dates) IS NOT NULL""")
def simple_entries(spark: SparkSession, d: str) -> DataFrame:
    """Lines between blank ones as an entry: the first that looks like a title, like a company, like dates."""
    kinds = {"title": L.ENTRY_TITLE, "company": L.ENTRY_COMPANY, "dates": L.ENTRY_RANGE}
    return R.simple_entries(V.resumes(spark, d), "candidate_id", "text", kinds)


@_query(f"""WITH {V.BLOCKS}, o AS (SELECT *, regexp_matches(text, '^[0-9]*0 ') AS title, lag(top) OVER (PARTITION BY doc, page ORDER BY top, left_edge, text) AS p FROM blocks), g AS (SELECT *, sum(CASE WHEN title OR top - p > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY top, left_edge, text ROWS UNBOUNDED PRECEDING) AS e FROM o)
SELECT doc, page, e AS entry_no, min(text) FILTER (WHERE title) AS title, count(*) FILTER (WHERE NOT title) AS n_blocks FROM g GROUP BY 1, 2, 3""")
def segment_entries(spark: SparkSession, d: str) -> DataFrame:
    """Typed layout blocks as entries: a title, or a gap of over 30, opens one."""
    return R.segment_entries(V.blocks(spark, d), "doc", F.col("text").rlike("^[0-9]*0 "), 30)


@_query(f"""WITH {V.RESUME_LINES}, w AS (SELECT candidate_id, line_no, unnest(string_split(line, ',')) AS item FROM resume_lines)
SELECT candidate_id, lower(trim(item)) AS key, min(line_no) AS first_line, count(*) AS n FROM w WHERE trim(item) <> '' GROUP BY 1, 2""")
def gathered_entries(spark: SparkSession, d: str) -> DataFrame:
    """Items of every text column of a résumé, gathered and deduplicated whatever their case."""
    every = lines.to_lines(V.resumes(spark, d), "candidate_id", "text").select("candidate_id", "line_no", F.explode(F.split("line", ",")).alias("item"))
    named = every.select("candidate_id", "line_no", F.lower(F.trim("item")).alias("key")).filter("key <> ''")
    return named.groupBy("candidate_id", "key").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))


# --- snapshots and caches -----------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One order by its key: that of the last line item."""
    key = table(spark, d, "lineitem").agg(F.max("l_orderkey").alias("k")).first()["k"]
    return by_key(table(spark, d, "orders"), "o_orderkey", key).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("""SELECT coalesce(c_custkey, s_suppkey) AS candidate_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS name, CASE WHEN s_suppkey IS NULL THEN [c_mktsegment] WHEN s_suppkey % 3 = 0 THEN NULL ELSE [s_name] END AS skills FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def profile_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Profiles whose names keep what the patch lacks and whose lists it always replaces."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("skills"))
    k = F.col("s_suppkey")
    patch = table(spark, d, "supplier").select(k.alias("candidate_id"), F.when(k % 2 == 0, F.col("s_name")).alias("name"), F.when(k % 3 != 0, F.array("s_name")).alias("skills"))
    return upserts.upsert(base, patch, ["candidate_id"], replace=("skills",))


@_query("""WITH v AS (SELECT o_custkey AS resume_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey) AS version_number FROM orders)
SELECT resume_id, o_orderkey, CAST(version_number AS INTEGER) AS version_number, version_number = max(version_number) OVER (PARTITION BY resume_id) AS is_current FROM v""")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as stored versions, the others appended to them: numbered on, the last one current."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("resume_id"), "o_orderkey", "o_orderdate", "o_orderstatus")
    order = ["o_orderdate", "o_orderkey"]
    old = o.filter("o_orderstatus = 'F'").withColumn("version_number", F.row_number().over(Window.partitionBy("resume_id").orderBy(*order)))
    return upserts.append_versions(old, o.filter("o_orderstatus <> 'F'"), "resume_id", "version_number", order).select("resume_id", "o_orderkey", "version_number", "is_current")


@_query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, event_type, ts + CASE event_type WHEN 'view' THEN INTERVAL 1 HOUR WHEN 'click' THEN INTERVAL 24 HOUR ELSE INTERVAL 30 MINUTE END AS expires_at FROM events, n WHERE ts + CASE event_type WHEN 'view' THEN INTERVAL 1 HOUR WHEN 'click' THEN INTERVAL 24 HOUR ELSE INTERVAL 30 MINUTE END > now""")
def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as cache entries, those that have not expired by the time of the last one."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    minutes = F.when(F.col("event_type") == "view", 60).when(F.col("event_type") == "click", 1440).otherwise(30)
    return ingest.unexpired(e, "ts", minutes, e.agg(F.max("ts").alias("t")).first()["t"])
