"""Registered queries over résumé texts and layout blocks, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import _any_of_sql, _posts, _query
from .functions import columns as C
from .functions import lexicons as L
from .functions import resumes as T
from .operators import lines, upserts
from .operators import resumes as R
from .plans import resumes as V
from .sources.tables import table

_Q = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_LINES_OF = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _section_sql(section: str, text: str = "text") -> str:
    return f"nullif(trim(regexp_extract({text}, '{T.section_pattern(section)}', 1)), '')"


# --- sections and entries -----------------------------------------------------------------------------------


@_query(f"""WITH {V.RESUMES}, s AS (SELECT candidate_id, text, {', '.join(f'{_section_sql(s)} AS {s}' for s in L.SECTION_HEADS)} FROM resumes)
SELECT candidate_id, {', '.join(L.SECTION_HEADS)}, CASE WHEN length(education) > 50 THEN education WHEN length(skills) > 100 THEN skills ELSE coalesce(projects, text) END AS chosen FROM s""")
def resume_sections(spark: SparkSession, d: str) -> DataFrame:
    """The text of each section, and the text a section would be read from if its column were the education's."""
    found = V.resumes(spark, d).select("candidate_id", "text", *[T.section_text(F.col("text"), s).alias(s) for s in L.SECTION_HEADS])
    return found.select("candidate_id", *L.SECTION_HEADS, T.choose_text(F.col("education"), F.col("skills"), F.col("projects"), F.col("text")).alias("chosen"))


def _entries_sql(section: str, split: str = "\\n\\n+") -> str:
    return f"""sec AS (SELECT candidate_id, {_section_sql(section)} AS sec FROM resumes),
raw AS (SELECT candidate_id, i - 1 AS entry_no, trim(l[i]) AS entry FROM (SELECT candidate_id, regexp_split_to_array(sec, '{split}') AS l FROM sec WHERE sec IS NOT NULL), unnest(generate_series(1, len(l))) AS t(i))"""


_WORK_SQL = f"""{V.RESUMES}, {_entries_sql("experience")}, ls AS (SELECT *, {_LINES_OF.format("entry")} AS ls FROM raw WHERE length(entry) >= 10),
ds AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '{L.ENTRY_RANGE}')) AS dated, list_filter(ls, lambda x: NOT regexp_matches(x, '{L.ENTRY_RANGE}')) AS other, nullif(trim(regexp_extract(ls[1], '{L.TITLE_AT_COMPANY}', 1)), '') AS one, nullif(trim(regexp_extract(ls[1], '{L.TITLE_AT_COMPANY}', 2)), '') AS two FROM ls),
cs AS (SELECT *, list_filter(other, lambda x: regexp_matches(x, '{L.ENTRY_COMPANY}') AND NOT regexp_matches(x, '{L.TITLE_AT_COMPANY}'))[1] AS suffixed FROM ds),
rs AS (SELECT *, coalesce(suffixed, two) AS company, list_filter(other, lambda x: x IS DISTINCT FROM suffixed) AS rest, nullif(regexp_extract(dated[1], '{L.ENTRY_RANGE}', 1), '') AS start_date, nullif(regexp_extract(dated[1], '{L.ENTRY_RANGE}', 2), '') AS stop FROM cs),
ts AS (SELECT *, coalesce(one, list_filter(list_transform(rest, lambda x: regexp_extract(x, '{L.ENTRY_TITLE}', 0)), lambda x: x <> '')[1]) AS title FROM rs),
work AS (SELECT candidate_id, entry_no, entry, title, company, start_date, CASE WHEN upper(stop) IN ('PRESENT', 'CURRENT', 'NOW') THEN 'present' ELSE stop END AS end_date,
  array_to_string(list_filter(rest, lambda x: x IS DISTINCT FROM title AND NOT (x = ls[1] AND one IS NOT NULL)), chr(10)) AS description FROM ts)"""


def _work(spark: SparkSession, d: str) -> DataFrame:
    raw = R.read_entries(V.resumes(spark, d).select("candidate_id", T.section_text(F.col("text"), "experience").alias("sec")), "candidate_id", "sec", "\n\n+", 10, T.work_entry)
    return raw.select("candidate_id", "entry_no", "entry", "e.*")


@_query(f"""WITH {_WORK_SQL} SELECT candidate_id, entry_no, title, company, start_date, end_date, description FROM work
WHERE NOT {_any_of_sql("upper(entry)", L.EDUCATION_WORDS)} AND company IS NOT NULL AND (title IS NOT NULL OR start_date IS NOT NULL)""")
def experience_entries(spark: SparkSession, d: str) -> DataFrame:
    """Work entries of every résumé; those of places of education, or that speak of education, are none."""
    e = _work(spark, d).filter(~T.is_school(F.col("company")) & ~C.any_of(F.upper("entry"), L.EDUCATION_WORDS))
    return e.filter("company IS NOT NULL AND (title IS NOT NULL OR start_date IS NOT NULL)").select("candidate_id", "entry_no", "title", "company", "start_date", "end_date", "description")


@_query(f"""WITH {_WORK_SQL}, a AS (SELECT *, coalesce(regexp_matches(title, '{L.SENTENCE_TITLE}') OR length(title) > 50, false) AS sentence FROM work WHERE NOT ({_any_of_sql("upper(entry)", L.EDUCATION_WORDS)} AND NOT {_any_of_sql("upper(entry)", L.WORK_WORDS)}))
SELECT candidate_id, entry_no, company, CASE WHEN title IS NULL OR sentence AND company IS NOT NULL THEN 'Not Specified' ELSE title END AS title FROM a
WHERE company IS NOT NULL OR coalesce(length(title) > 2 AND {_any_of_sql("upper(title)", L.JOB_WORDS)} AND NOT sentence, false)""")
def accepted_entries(spark: SparkSession, d: str) -> DataFrame:
    """Work entries under the looser rule: all but pure education, with a company or a title that can be one."""
    kept, title = T.accepted(F.col("title"), F.col("company"))
    return _work(spark, d).filter(~T.pure_education(F.col("entry"))).filter(kept).select("candidate_id", "entry_no", "company", title.alias("title"))


@_query(f"""WITH {V.RESUMES}, {_entries_sql("education", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n|" + chr(92) + "n" + chr(92) + "s*[-•]" + chr(92) + "s*")}, ls AS (SELECT *, {_LINES_OF.format("entry")} AS ls FROM raw WHERE length(entry) >= 5),
g AS (SELECT *, coalesce({', '.join(f"list_filter(ls, lambda x: regexp_matches(x, '{p}'))[1]" for p in L.DEGREES)}) AS degree, nullif(regexp_extract(entry, '{L.INSTITUTION}', 0), '') AS institution, nullif(regexp_extract(entry, '\\b(?:19|20)\\d{{2}}\\b', 0), '') AS year FROM ls),
f AS (SELECT *, substr(entry, strpos(entry, degree) + length(degree)) AS rest FROM g WHERE degree IS NOT NULL OR institution IS NOT NULL)
SELECT candidate_id, entry_no, coalesce(degree, 'Unknown') AS degree, coalesce(institution, 'Unknown') AS institution, nullif(regexp_replace(CASE WHEN contains(rest, institution) THEN substr(rest, 1, strpos(rest, institution) - 1) END, '^[\\s,–—-]+|[\\s,–—-]+$', '', 'g'), '') AS field, year FROM f""")
def education_entries(spark: SparkSession, d: str) -> DataFrame:
    raw = R.read_entries(V.resumes(spark, d).select("candidate_id", T.section_text(F.col("text"), "education").alias("sec")), "candidate_id", "sec", r"\n\s*\n|\n\s*[-•]\s*", 5, T.education_entry)
    e = raw.filter("e.degree IS NOT NULL OR e.institution IS NOT NULL")
    return e.select("candidate_id", "entry_no", F.coalesce("e.degree", F.lit("Unknown")).alias("degree"), F.coalesce("e.institution", F.lit("Unknown")).alias("institution"), F.col("e.field").alias("field"), F.col("e.year").alias("year"))


@_query(f"""WITH {V.RESUMES}, {_entries_sql("projects")}, ls AS (SELECT *, {_LINES_OF.format("entry")} AS ls FROM raw WHERE length(entry) >= 10)
SELECT candidate_id, entry_no, ls[1] AS name, array_to_string(ls[2:], chr(10)) AS description, nullif(regexp_extract(entry, 'https?://[^\\s]+', 0), '') AS url, list_filter({_Q(L.PROJECT_TECHNOLOGIES)}, lambda t: contains(lower(entry), lower(t))) AS technologies FROM ls
WHERE length(ls[1]) <= 60 AND lower(ls[1]) NOT IN ({', '.join(repr(w) for w in L.SUMMARY_NAMES)}) AND NOT (regexp_matches(entry, '{L.SUMMARY_WORDS}') AND length(entry) > 100)""")
def project_entries(spark: SparkSession, d: str) -> DataFrame:
    raw = R.read_entries(V.resumes(spark, d).select("candidate_id", T.section_text(F.col("text"), "projects").alias("sec")), "candidate_id", "sec", "\n\n+", 0, T.project_entry)
    return raw.filter("e IS NOT NULL").select("candidate_id", "entry_no", "e.*")


def _items_sql(section: str, shortest: int, longest: int) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({_section_sql(section)}, '[,;\\n•]'), lambda x: trim(regexp_replace(x, '\\s*\\([^)]+\\)', '', 'g'))), lambda x: length(x) BETWEEN {shortest} AND {longest})"


@_query(f"WITH {V.RESUMES} SELECT candidate_id, {_items_sql('certifications', 3, 49)} AS certifications, {_items_sql('languages', 2, 29)} AS languages FROM resumes")
def certifications_languages(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return V.resumes(spark, d).select("candidate_id", T.list_items(T.section_text(text, "certifications"), 3, 49).alias("certifications"), T.list_items(T.section_text(text, "languages"), 2, 29).alias("languages"))


# --- skills -------------------------------------------------------------------------------------------------


def _clean_expr(raw: str) -> tuple[str, str]:
    """(bare, name) of the cleaning of a skill, as SQL expressions."""
    bare = f"trim({raw})"
    for pattern in L.SKILL_NOISE:
        bare = f"regexp_replace({bare}, '{pattern}', '', 'g')"
    return bare, f"regexp_replace(trim(regexp_replace(bare, '{L.SKILL_ALTERNATIVES}', '')), '[.,;:]+$', '')"


_BARE, _CLEAN_NAME = _clean_expr("raw")
_CATEGORY_SQL = f"""{V.RESUMES}, sl AS (SELECT candidate_id, i AS line_no, trim(l[i]) AS line FROM (SELECT candidate_id, string_split({_section_sql("skills")}, chr(10)) AS l FROM resumes), unnest(generate_series(1, len(l))) AS t(i)),
cn AS (SELECT *, trim(regexp_extract(line, '^([^:]+):', 1)) AS c FROM sl WHERE line <> ''), cg AS (SELECT *, CASE WHEN c <> '' AND length(c) <= 25 AND len(regexp_split_to_array(c, '\\s+')) <= 3 AND NOT regexp_matches(c, '{L.CATEGORY_BARRED}') THEN c END AS category FROM cn),
cw AS (SELECT *, last_value(category IGNORE NULLS) OVER w AS own, count(category) OVER w AS no FROM cg WINDOW w AS (PARTITION BY candidate_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
ct AS (SELECT candidate_id, no, own, string_agg(CASE WHEN category IS NULL THEN line ELSE trim(regexp_replace(line, '^[^:]+:', '')) END, ' ' ORDER BY line_no) AS body FROM cw WHERE own IS NOT NULL GROUP BY candidate_id, no, own),
ck AS (SELECT *, regexp_split_to_array(regexp_replace(trim(regexp_replace(body, '{L.CATEGORY_STOP}', '')), '[.,;]+$', ''), '[,;|/]') AS l FROM ct), cr AS (SELECT candidate_id, no, own, i AS place, l[i] AS raw FROM ck, unnest(generate_series(1, len(l))) AS t(i)),
cb AS (SELECT *, {_BARE} AS bare FROM cr), cz AS (SELECT *, {_CLEAN_NAME} AS name FROM cb),
cs AS (SELECT candidate_id, no, own AS category, place, CASE WHEN length(trim(raw)) <= 35 AND NOT (regexp_matches(bare, '{L.SKILL_PHRASE}') AND NOT {_any_of_sql("lower(bare)", L.SKILL_PHRASE_NAMES)}) AND len(regexp_split_to_array(trim(name), '\\s+')) <= 3 AND length(name) >= 2 THEN name END AS skill FROM cz),
good AS (SELECT * FROM cs WHERE coalesce(length(skill) BETWEEN 2 AND 50 AND NOT (regexp_matches(lower(trim(skill)), '^[\\d./-]+$') OR lower(trim(skill)) IN ({', '.join(repr(w) for w in L.SKILL_STOP_WORDS)}) OR regexp_matches(skill, '\\b(?:19|20)\\d{{2}}\\s*[-–—]')
  OR {_any_of_sql("lower(trim(skill))", L.COMPANY_MARKS)} OR {_any_of_sql("lower(trim(skill))", L.ACTION_VERBS)}) AND (regexp_matches(skill, '[A-Z./0-9]') AND length(skill) <= 30 OR regexp_matches(skill, '^[a-z]{{3,15}}$')), false))"""


def _category_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.to_lines(V.resumes(spark, d).select("candidate_id", T.section_text(F.col("text"), "skills").alias("sec")).filter("sec IS NOT NULL"), "candidate_id", "sec")
    return R.categorised(rows, "candidate_id").select("candidate_id", "no", "category", F.posexplode(T.category_skills(F.col("body"))).alias("place", "skill"))


@_query(f"WITH {_CATEGORY_SQL} SELECT candidate_id, category, skill FROM good")
def categorised_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of lines like "Tools: docker; git", with their category, up to the first action verb."""
    return _category_rows(spark, d).select("candidate_id", "category", "skill")


@_query(f"""WITH {_CATEGORY_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, lower(skill) ORDER BY no, place) AS rn FROM good), u AS (SELECT candidate_id, lower(skill) AS low, skill FROM o WHERE rn = 1)
SELECT candidate_id, list(skill ORDER BY low, skill) AS skills FROM u AS a WHERE NOT EXISTS (SELECT 1 FROM u AS b WHERE a.candidate_id = b.candidate_id AND a.low <> b.low AND contains(a.low, b.low)) GROUP BY candidate_id""")
def improved_skills(spark: SparkSession, d: str) -> DataFrame:
    """Each résumé's categorised skills: repeats that differ in case and longer forms of a kept skill folded, sorted whatever the case."""
    listed = _category_rows(spark, d).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("no", "place", "skill"))).alias("s"))
    first = listed.select("candidate_id", F.explode(T.ordered_distinct(F.transform("s", lambda x: x["skill"]))).alias("skill"))
    kept = upserts.fold_terms(first, "candidate_id", "skill")
    return kept.groupBy("candidate_id").agg(T.sort_ignoring_case(F.collect_list("skill")).alias("skills"))


@_query(f"""WITH {V.RESUMES} SELECT candidate_id, list_sort(list_distinct(list_concat(list_filter({_Q(L.JOB_SKILLS)}, lambda w: contains(lower(text), w)), coalesce(list_filter(list_transform(regexp_split_to_array({_section_sql("skills")}, '[,;\\n]'), lambda x: trim(x)), lambda x: length(x) > 2), [])))) AS skills FROM resumes""")
def rule_skills(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon words of the whole text and the items of the skills section."""
    return V.resumes(spark, d).select("candidate_id", F.array_sort(T.rule_skills(F.col("text"), L.JOB_SKILLS)).alias("skills"))


def _post_list(section: str, lead: str, extra: str = "") -> str:
    each = ", ".join(f"CASE WHEN contains(lower(regexp_extract(text, '{section}', 1)), '{w}') OR regexp_matches(array_to_string(regexp_extract_all(low, '{lead}([^\\n]*)', 1), chr(10)), '(?:^|[^a-z0-9_]){T._escaped(w)}(?:$|[^a-z0-9_])') THEN '{w}' END" for w in L.JOB_SKILLS)
    return f"list_sort(list_distinct(list_filter([{each}{extra}], lambda x: x IS NOT NULL)))"


_FULL = "regexp_matches(low, 'full[ -]?stack')"
_IMPLIED = f", CASE WHEN {_FULL} AND contains(low, 'html') THEN 'html' END, CASE WHEN {_FULL} AND contains(low, 'css') THEN 'css' END, CASE WHEN {_FULL} AND (contains(low, 'rest') OR contains(low, 'api')) THEN 'rest api' END"
_ASK = """CASE turn % 4 WHEN 0 THEN chr(10) || 'Requirements: Python, ' || CASE WHEN conv_id % 2 = 0 THEN 'SQL' ELSE 'Scala; Redis' END || chr(10) || 'nice to have: Docker, go' WHEN 1 THEN chr(10) || 'You must know c++ and react. Terraform preferred, with aws' || chr(10) || 'full-stack: html, css, api' WHEN 2 THEN chr(10) || 'Must have' || chr(10) || 'numpy' || chr(10) || chr(10) || 'rust is a plus: kotlin' ELSE '' END"""


@_query(f"WITH t AS (SELECT conv_id, turn, text || {_ASK} AS text FROM conversations), l AS (SELECT *, lower(text) AS low FROM t) SELECT conv_id, turn, {_post_list(L.POST_REQUIRED, L.POST_MUST, _IMPLIED)} AS required, {_post_list(L.POST_NICE, L.POST_MAY)} AS nice FROM l")
def post_skills(spark: SparkSession, d: str) -> DataFrame:
    """Required and nice-to-have skills of job posts, which the turns of conversations stand for."""
    required, nice = T.post_skills(F.col("text"), L.JOB_SKILLS)
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(f"text || {_ASK}").alias("text")).select("conv_id", "turn", required.alias("required"), nice.alias("nice"))


# --- names and links ----------------------------------------------------------------------------------------


@_query(f"""WITH {V.RESUME_LINES}, n AS (SELECT candidate_id, trim(line) AS name, row_number() OVER (PARTITION BY candidate_id ORDER BY line_no) AS rn FROM resume_lines WHERE line_no < 5 AND regexp_matches(trim(line), '^[A-Z][A-Za-z''.-]{{1,14}}(?:\\s+[A-Z][A-Za-z''.-]{{1,14}}){{1,3}}$') AND NOT {_any_of_sql("lower(trim(line))", L.NAME_BARRED)}),
h AS (SELECT candidate_id, string_agg(line, chr(10) ORDER BY line_no) AS head FROM resume_lines WHERE line_no < 5 GROUP BY candidate_id)
SELECT h.candidate_id, coalesce(string_split(name, ' ')[1], 'unknown') AS first_name, coalesce(nullif(substr(name, strpos(name, ' ') + 1), ''), 'unknown') AS last_name, nullif(regexp_extract(head, '{L.EMAIL}'), '') AS email, coalesce({', '.join(f"nullif(regexp_extract(head, '{p}'), '')" for p in L.PHONES)}) AS phone FROM h LEFT JOIN n ON n.candidate_id = h.candidate_id AND rn = 1""")
def header_info(spark: SparkSession, d: str) -> DataFrame:
    """Name, e-mail and phone from the first five lines; the first line that can be a name is it."""
    head = lines.to_lines(V.resumes(spark, d), "candidate_id", "text").filter("line_no < 5")
    named = lines.priority_pick(head.filter(T.looks_like_name(F.col("line"))).withColumn("priority", 10 - F.col("line_no")), "candidate_id", "priority", "line_no").select("candidate_id", F.trim("line").alias("name"))
    first, last = C.split_name(F.col("name"))
    whole = head.groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("head"))
    return whole.join(named, "candidate_id", "left").select("candidate_id", first.alias("first_name"), last.alias("last_name"), C.first_email(F.col("head")).alias("email"), C.first_phone(F.col("head")).alias("phone"))


_HOST = "regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([^./]+)', 1)"
_LINKS_SQL = f"""{V.RESUMES}, ul AS (SELECT candidate_id, i AS place, l[i] AS url FROM (SELECT candidate_id, regexp_extract_all(text, '{L.URL}') AS l FROM resumes), unnest(generate_series(1, len(l))) AS t(i)),
uk AS (SELECT *, CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN {_HOST} IN ({', '.join(repr(w) for w in L.MAIL_HOSTS)}) THEN NULL WHEN {_any_of_sql("lower(url)", L.OTHER_SITES)} THEN 'other' ELSE 'portfolio' END AS kind FROM ul),
links AS (SELECT candidate_id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS url, kind, min(place) AS place FROM uk WHERE kind IS NOT NULL GROUP BY ALL)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    found = V.resumes(spark, d).select("candidate_id", F.posexplode(F.regexp_extract_all("text", F.lit(L.URL), F.lit(0))).alias("place", "url"))
    kinds = found.withColumn("kind", T.url_kind(F.col("url"))).filter("kind IS NOT NULL")
    return kinds.groupBy("candidate_id", C.normalize_url(F.col("url")).alias("url"), "kind").agg((F.min("place") + 1).cast("long").alias("place"))


@_query(f"WITH {_LINKS_SQL} SELECT candidate_id, url, kind, place FROM links")
def link_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct link of a résumé with its kind and first place; mail hosts are none."""
    return _links(spark, d)


@_query(f"WITH {_LINKS_SQL} SELECT candidate_id, arg_min(url, place) AS portfolio_url FROM links WHERE kind = 'portfolio' GROUP BY candidate_id")
def portfolio_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first link of a résumé that is a site of its own."""
    return _links(spark, d).filter("kind = 'portfolio'").groupBy("candidate_id").agg(F.min_by("url", "place").alias("portfolio_url"))


# --- lines and columns --------------------------------------------------------------------------------------

_FLAG_SQL = {
    "dates": f"regexp_matches(upper(line), '{L.DATE_RANGE}')", "title": f"regexp_matches(line, '{L.CONTENT_TITLES}')", "company": f"regexp_matches(line, '{L.CONTENT_COMPANIES}')", "work": _any_of_sql("lower(line)", L.CONTENT_WORK),
    "school": _any_of_sql("lower(line)", L.CONTENT_SCHOOL), "tech": f"(regexp_matches(line, '{L.CONTENT_TECH_LIST}') OR {' + '.join(f'contains(lower(line), {w!r})::INT' for w in L.CONTENT_TECH)} >= 3)",
    "project": f"({_any_of_sql('lower(line)', L.CONTENT_PROJECT)} AND (regexp_matches(line, 'https?://[^\\s]+') OR regexp_matches(lower(line), 'github\\.com/[\\w-]+/[\\w-]+')))",
}
_ENDS = " ".join(f"WHEN '{s}' THEN {_any_of_sql('upper(trim(r.line))', ws) if ws else 'false'}" for s, ws in L.CONTENT_ENDS.items())


@_query(f"""WITH {V.RESUME_LINES}, f AS (SELECT candidate_id, line_no, {', '.join(f'{e} AS {n}' for n, e in _FLAG_SQL.items())} FROM resume_lines),
g AS (SELECT candidate_id, count(*) AS n, sum(dates::INT) AS dates, sum(title::INT) AS titles, sum(company::INT) AS companies, min(CASE WHEN dates OR title OR company OR work THEN line_no END) AS a, min(CASE WHEN school THEN line_no END) AS b, min(CASE WHEN tech THEN line_no END) AS c, min(CASE WHEN project THEN line_no END) AS p FROM f GROUP BY candidate_id),
s AS (SELECT candidate_id, n, 'experience' AS section, a AS start FROM g WHERE a IS NOT NULL AND (dates >= 2 OR titles >= 1 AND companies >= 1) UNION ALL SELECT candidate_id, n, 'education', b FROM g WHERE b IS NOT NULL UNION ALL SELECT candidate_id, n, 'skills', c FROM g WHERE c IS NOT NULL UNION ALL SELECT candidate_id, n, 'projects', p FROM g WHERE p IS NOT NULL),
w AS (SELECT *, trim(line) = '' AND coalesce(trim(lead(line) OVER (PARTITION BY candidate_id ORDER BY line_no)) = '', false) AS pair FROM resume_lines),
e AS (SELECT s.candidate_id, s.section, s.start, s.n, min(CASE WHEN pair THEN r.line_no WHEN CASE s.section {_ENDS} END THEN r.line_no - 1 END) AS stop FROM s LEFT JOIN w AS r ON r.candidate_id = s.candidate_id AND r.line_no > s.start AND r.line_no < s.start + least(50, n - s.start) GROUP BY ALL)
SELECT candidate_id, section, start, coalesce(stop, least(start + least(50, n - start), n - 1)) AS "end" FROM e""")
def content_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of résumés by what their lines hold, without any header."""
    return R.content_sections(V.resumes(spark, d), "candidate_id", "text").drop("body")


@_query(f"""WITH {V.RESUME_LINES}, p AS (SELECT candidate_id, line_no, line, strpos(line, ',') AS pos FROM resume_lines), m AS (SELECT candidate_id, mode_at FROM (SELECT candidate_id, pos AS mode_at, row_number() OVER (PARTITION BY candidate_id ORDER BY count(*) DESC, pos) AS rn FROM p WHERE pos > 0 GROUP BY candidate_id, pos) WHERE rn = 1),
c AS (SELECT p.candidate_id, line_no, CASE WHEN length(line) > mode_at THEN trim(substr(line, 1, mode_at)) ELSE trim(line) END AS l, CASE WHEN length(line) > mode_at THEN trim(substr(line, mode_at + 1)) ELSE '' END AS r FROM p JOIN m USING (candidate_id))
SELECT candidate_id, line_no, l AS left_text, r AS right_text, CASE WHEN l <> '' AND r <> '' THEN 'both' WHEN r <> '' THEN 'right' ELSE 'left' END AS label FROM c""")
def column_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line cut where most lines of its résumé have their first comma, which stands for a column separator, with the column it lies in."""
    return R.split_columns(lines.to_lines(V.resumes(spark, d), "candidate_id", "text"), "candidate_id", ",")


@_query(f"""WITH {V.RESUME_LINES}, h AS (SELECT *, upper(trim(line)) = trim(line) AND regexp_matches(line, '[A-Z]') AND length(trim(line)) < 50 AND len(regexp_split_to_array(trim(line), '\\s+')) <= 3 AS header FROM resume_lines WHERE trim(line) <> ''),
b AS (SELECT *, sum(header::INT) OVER (PARTITION BY candidate_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM h)
SELECT candidate_id, block, min(CASE WHEN header THEN trim(line) END) AS header, count(*) FILTER (WHERE NOT header) AS n_lines, string_agg(trim(line), chr(10) ORDER BY line_no) FILTER (WHERE NOT header) AS text FROM b GROUP BY candidate_id, block""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a text: a short line in capitals heads the lines that follow it."""
    return R.text_blocks(lines.to_lines(V.resumes(spark, d), "candidate_id", "text"), "candidate_id")


@_query(f"""WITH {V.RESUME_LINES}, f AS (SELECT candidate_id, line_no, regexp_matches(line, '{L.ENTRY_TITLE}') AS t, regexp_matches(line, '{L.ENTRY_COMPANY}') AS c, trim(line) = '' AS b FROM resume_lines),
s AS (SELECT *, sum(t::INT) OVER w AS by_title, sum(c::INT) OVER w AS by_company, sum(b::INT) OVER w AS by_blank FROM f WINDOW w AS (PARTITION BY candidate_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
m AS (SELECT candidate_id, max(by_title) AS nt, max(by_company) AS nc FROM s GROUP BY candidate_id)
SELECT s.candidate_id, line_no, CASE WHEN nt >= 2 THEN 'title' WHEN nc >= 2 THEN 'company' ELSE 'blank' END AS splitter, CASE WHEN nt >= 2 THEN by_title WHEN nc >= 2 THEN by_company ELSE by_blank END AS entry_id FROM s JOIN m USING (candidate_id)""")
def fallback_split(spark: SparkSession, d: str) -> DataFrame:
    """Entries by title lines, else by company lines, else by blank lines: the first way that gives two or more."""
    line = F.col("line")
    ways = {"title": line.rlike(L.ENTRY_TITLE), "company": line.rlike(L.ENTRY_COMPANY), "blank": F.trim(line) == ""}
    return R.fallback_split(lines.to_lines(V.resumes(spark, d), "candidate_id", "text"), "candidate_id", ways, 2)


@_query(f"""WITH {V.BLOCKS}, m AS (SELECT *, (max(left_edge) OVER w + min(left_edge) OVER w) / 2 AS mid, max(left_edge) OVER w - min(left_edge) OVER w AS width FROM blocks WINDOW w AS (PARTITION BY doc, page)),
a AS (SELECT doc, page, any_value(width) AS width, avg(left_edge) FILTER (WHERE left_edge < mid) AS l, avg(left_edge) FILTER (WHERE left_edge >= mid) AS r FROM m GROUP BY doc, page)
SELECT doc, page, round(l, 6) AS left_mean, round(r, 6) AS right_mean, coalesce(l > 0 AND r > 0 AND r - l > width * 0.25, false) AS two_columns FROM a""")
def column_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean left edges of a page's two halves, and whether they lie a quarter of its width apart."""
    return R.column_means(V.blocks(spark, d), "doc").select("doc", "page", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"), "two_columns")


@_query(f"""WITH {V.BLOCKS}, e AS (SELECT DISTINCT doc, page, left_edge, page_width FROM blocks), g AS (SELECT *, lag(left_edge) OVER (PARTITION BY doc, page ORDER BY left_edge) AS p FROM e),
s AS (SELECT doc, page, arg_max((left_edge + p) / 2, row(left_edge - p, -left_edge)) AS split FROM g WHERE left_edge - p > 50 AND left_edge - p > page_width * 0.05 GROUP BY doc, page),
z AS (SELECT doc, page, split, sum(length(text)) FILTER (WHERE left_edge < split) AS l, sum(length(text)) FILTER (WHERE left_edge >= split) AS r FROM blocks JOIN s USING (doc, page) GROUP BY ALL) SELECT doc, page, split FROM z WHERE l > 100 AND r > 100""")
def block_columns(spark: SparkSession, d: str) -> DataFrame:
    """Where a page's blocks fall into two columns."""
    return lines.column_split(V.blocks(spark, d), "doc")


@_query(f"""WITH {V.BLOCKS}, o AS (SELECT *, CASE WHEN abs(top - lag(top) OVER w) >= 20 THEN 1 ELSE 0 END AS new FROM blocks WINDOW w AS (PARTITION BY doc, page ORDER BY top, left_edge, text)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY top, left_edge, text ROWS UNBOUNDED PRECEDING) AS "group" FROM o)
SELECT doc, page, "group", string_agg(text, ' ' ORDER BY top, left_edge, text) AS text FROM g GROUP BY ALL""")
def block_groups(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in reading order, a new group where the next one stands 20 or more below."""
    return lines.vertical_groups(V.blocks(spark, d), "doc")


@_query(f"""WITH {V.BLOCKS}, h AS (SELECT doc, page, top, left_edge, text, CASE WHEN top > 20 AND regexp_matches(text, '^[0-9]*[05] ') THEN 'heading' END AS section FROM blocks)
SELECT doc, top, text, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, top, left_edge, text ROWS UNBOUNDED PRECEDING), CASE WHEN top < 30 THEN 'header' ELSE 'other' END) AS label FROM h""")
def block_labels(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with the latest heading above them; before any, those near the top are the header and the rest are other."""
    marked = V.blocks(spark, d).withColumn("section", F.when((F.col("top") > 20) & F.col("text").rlike("^[0-9]*[05] "), "heading"))
    return R.block_labels(marked, "doc", near_top=30).select("doc", "top", "text", "label")
