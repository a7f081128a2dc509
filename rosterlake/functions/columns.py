"""Column expressions: skills, contacts, links, dates, job posts, document checks, tiers and scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton
from . import lexicons as L


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once per row, however often use names it: a plain expression is copied wherever it is named.

    An aggregate over no elements does so; taking the one element of a transformed array would work out the type of all that is inside, each time.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words stand in text."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def first_match(text: Column, patterns: list[str], group: int = 0) -> Column:
    """The first pattern's first match, else the next pattern's."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


# --- skills -------------------------------------------------------------------------------------------------


def normalize_skill(skill: Column) -> Column:
    """Lower case; only word characters, blanks and hyphens; one blank between words; two-word terms in the singular."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(skill, F.lit("")))), r"[^\w\s-]", ""), r"[\s-]+", " "))
    words = F.split(bare, " ")
    last = reduce(lambda c, p: F.when(F.get(words, 1) == p[0], p[1]).otherwise(c), L.PLURALS.items(), F.get(words, 1))
    return F.when(F.size(words) == 2, F.concat_ws(" ", F.get(words, 0), last)).otherwise(bare)


def singular(norm: Column) -> Column:
    return F.when(norm.endswith("s") & (F.length(norm) > 3), F.regexp_replace(norm, "s+$", "")).otherwise(norm)


def split_skills(text: Column) -> Column:
    """Items of a skill list: by comma, else semicolon, else the word and, else bullet, else line; 2 to 50 characters."""
    by = F.when(text.contains(","), F.split(text, ",")).when(text.contains(";"), F.split(text, ";")).when(F.lower(text).contains(" and "), F.split(text, "(?i) and ")).when(text.contains("•"), F.split(text, "•")).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(by, lambda x: F.trim(x)), lambda x: F.length(x).between(2, 50))


def looks_technical(term: Column) -> Column:
    """A dot inside, an inner capital, a digit, or one short lower-case word."""
    return term.rlike(r"\w\.\w|[a-z][A-Z]|\d|^[a-z]{2,6}$")


# --- contacts, links, names ---------------------------------------------------------------------------------


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, L.EMAIL, 0), F.lit(""))


def first_phone(text: Column) -> Column:
    return first_match(text, L.PHONES)


def phone_digits(phone: Column) -> Column:
    """Digits and plus signs, null for fewer than ten."""
    bare = F.regexp_replace(phone, r"[^\d+]", "")
    return F.when(F.length(bare) >= 10, bare)


def normalize_url(url: Column) -> Column:
    clean = F.trim(url)
    return F.when((clean == "") | (F.lower(clean) == "unknown"), F.lit(None)).when(clean.rlike("^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))


def link_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("linkedin.com"), "linkedin").when(low.contains("github.com"), "github").when(low.rlike(r"gmail\.|yahoo\.|outlook\.|hotmail\."), "mail").when(low.rlike(r"portfolio|blog|behance|dribbble|\.dev|\.me"), "portfolio").otherwise("other")


def display_name(first: Column, last: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))


def split_name(name: Column) -> tuple[Column, Column]:
    """(first token, remainder), 'unknown' for what is missing."""
    parts = F.split(F.trim(name), r"\s+", 2)
    return F.coalesce(F.nullif(F.get(parts, 0), F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(F.get(parts, 1), F.lit("")), F.lit("unknown"))


# --- dates --------------------------------------------------------------------------------------------------


def parse_date(text: Column, as_of: Column, *, year_end: bool = False) -> Column:
    """A date in any of the usual forms; 'present' is as_of; else the first year found, its last day with year_end."""
    t = F.trim(text)
    month_year = [F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(F.lower(t))), F.lit(f))) for f in ("d MMMM yyyy", "d MMM yyyy")]
    numeric = [
        F.when(t.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(t, F.lit("-1")), "yyyy-M-d")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d")),
        F.when(t.rlike(r"^\d{1,2}/\d{4}$"), F.try_to_date(F.concat(F.lit("1/"), t), "d/M/yyyy")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy")),
    ]
    year = F.nullif(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    by_year = F.try_to_date(F.concat(year, F.lit("-12-31" if year_end else "-01-01")), "yyyy-MM-dd")
    worded = F.when(t.rlike(r"^[A-Za-z]+\.? \d{4}$"), F.coalesce(*month_year))
    return F.when(F.lower(t).rlike("present|current|now"), as_of).otherwise(F.coalesce(*numeric, worded, by_year))


def normalize_date(text: Column, as_of: Column) -> Column:
    """present, YYYY or YYYY-MM."""
    t = F.trim(text)
    return F.when(F.lower(t).rlike("present|current|now"), "present").when(t.rlike(r"^\d{4}$"), t).otherwise(F.date_format(parse_date(t, as_of), "yyyy-MM"))


def date_range(line: Column) -> Column:
    """(start, end) texts of the first range in a line, whole months included."""
    one = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{4}|\d{1,2}/\d{4}|(?:19|20)\d{2})"
    pattern = rf"(?i)({one})\s*(?:-|–|—|to)\s*({one}|present|current|now)"
    return F.struct(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("start"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("end"))


def stated_years(text: Column) -> Column:
    """Years of experience that a post states: the first pattern with a number from 1 to 20, its first such number."""
    def first(pattern: str) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), lambda x: F.expr("1") * x.try_cast("int"))
        return F.get(F.filter(numbers, lambda x: x.between(1, 20)), 0)

    return F.coalesce(*[first(p) for p in L.YEARS_PATTERNS])


# --- job posts ----------------------------------------------------------------------------------------------


def skills_in(text: Column, words: list[str] = L.JOB_SKILLS, *, whole_words: bool = False) -> Column:
    """Lexicon words that stand in text, in lexicon order; by substring unless whole_words."""
    low = F.lower(text)
    if whole_words:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.regexp_like(low, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), w, F.lit(r"\E([^a-z0-9]|$)"))))
    return automaton.found(low, words)


def post_seniority(text: Column) -> Column:
    """Level by the leading title word, else by the first level with a keyword in the text, else by years."""
    low, years = F.lower(text), stated_years(text)
    title = F.regexp_extract(low, "^(" + "|".join(L.SENIORITY_TITLES) + ")", 1)
    by_title = reduce(lambda c, p: F.when(title.isin(p[1]), p[0]).otherwise(c), reversed(L.SENIORITY_WORDS.items()), F.lit(None).cast("string"))
    by_word = reduce(lambda c, p: F.when(any_of(low, p[1]), p[0]).otherwise(c), reversed(L.SENIORITY_WORDS.items()), F.lit(None).cast("string"))
    return F.coalesce(by_title, by_word, F.when(years >= 7, "senior").when(years >= 4, "mid").when(years >= 1, "junior"))


def education_flags(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), name) for name, p in L.EDUCATION_PATTERNS.items()]), lambda x: x.isNotNull())


def job_location(text: Column) -> Column:
    return F.trim(first_match(text, ["(?i)" + p for p in L.LOCATION_PATTERNS], 1))


def remote_allowed(text: Column) -> Column:
    low = F.lower(text)
    return any_of(low, L.REMOTE) & ~any_of(low, L.ON_SITE)


def employment_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, ["full-time", "full time"]), "full-time").when(any_of(low, ["part-time", "part time"]), "part-time").when(low.contains("contract"), "contract").when(low.contains("intern"), "internship")


# --- documents ----------------------------------------------------------------------------------------------


def with_validity(df: DataFrame, text: str) -> DataFrame:
    """df with score, is_valid and reasons of the check whether a text is a résumé; texts under 200 characters score 0.

    All words are looked for in one pass over the text, whatever their number, and in the same pass what a match of each
    pattern must hold; only texts that hold it are searched for the pattern. The signs are columns of their own, so that this
    is done once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    dates = ["19", "20", "present", "pre\u017fent", "current"]  # small letters whose capitals a date range may have
    words = [w for _, _, ws in L.VALIDITY_FAMILIES.values() for w in ws] + L.OTHER_DOCUMENTS + ["@", *"0123456789", *dates]
    holds = lambda *signs: F.arrays_overlap(found, F.array(*[F.lit(x) for x in signs]))
    df, found = df.withColumn("_found", automaton.found(F.lower(t), words)), F.col("_found")
    signs = {
        "long": F.length(F.trim(t)) >= L.SHORTEST_TEXT, "email": F.when(holds("@"), t.rlike(L.EMAIL)).otherwise(False), "phone": F.when(holds(*"0123456789"), t.rlike(L.LOOSE_PHONE)).otherwise(False),
        "ranges": F.when(holds(*dates), F.regexp_count(F.upper(t), F.lit(L.DATE_RANGE))).otherwise(0),
        **{k: automaton.hits(found, ws) for k, (_, _, ws) in L.VALIDITY_FAMILIES.items()}, "other": automaton.hits(found, L.OTHER_DOCUMENTS),
    }
    s = {k: F.col("_signs")[k] for k in signs}
    points = reduce(lambda a, b: a + b, [F.least(s[k] * each, F.lit(most)) for k, (each, most, _) in L.VALIDITY_FAMILIES.items()])
    both = (s["email"] & s["phone"]).cast("int") * 5 + ((s["experience"] > 0) & (s["education"] > 0)).cast("int") * 5
    score = s["email"].cast("int") * 15 + s["phone"].cast("int") * 10 + (s["ranges"] >= 2).cast("int") * 10 + points - F.least(s["other"] * 5, F.lit(30)) + both
    valid = s["long"] & (F.col("score") >= L.VALID_FROM)
    short = s["long"] & ~valid
    reasons = F.filter(F.array(
        F.when(~s["long"], "text_too_short"), F.when(short & ~s["email"] & ~s["phone"], "missing_contact_info"), F.when(short & (s["experience"] == 0), "no_experience_indicators"),
        F.when(short & (s["education"] == 0), "no_education_indicators"), F.when(short & (s["other"] > 0), "contains_non_resume_content"),
    ), lambda x: x.isNotNull())
    named = df.withColumn("_signs", F.struct(*[c.alias(k) for k, c in signs.items()]))
    scored = named.withColumn("score", F.when(s["long"], score).otherwise(0))
    return scored.withColumn("is_valid", valid).withColumn("reasons", reasons).drop("_signs", "_found")


def scanned(text: Column) -> Column:
    """Little text: under 100 characters or under 20 words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) < 100) | (F.regexp_count(t, F.lit(r"\S+")) < 20)


def parse_quality(skills: Column, years: Column, experience: Column, education: Column, projects: Column, length: Column, categories: Column, layout: Column, fallback: Column, dated: Column | None = None) -> Column:
    """0 to 100 from counts: skills, years, entries, text length, categories filled, layout confidence, fallback parser; a single entry without any date counts half."""
    def steps(x: Column, *levels: tuple[int, int]) -> Column:
        return reduce(lambda c, s: F.when(x >= s[0], s[1]).otherwise(c), reversed(levels), F.lit(0))

    total = steps(skills, (10, 20), (5, 15), (3, 10), (1, 5)) + steps(years, (1, 20)) + steps(experience, (3, 20), (2, 15), (1, 10)) + steps(education, (2, 15), (1, 10)) + steps(projects, (2, 10), (1, 5)) + steps(length, (501, 10), (201, 5)) + steps(categories, (3, 5)) + F.when(layout >= 0.8, 15).when(layout >= 0.5, 8).otherwise(0)
    if dated is not None:
        total = total - F.when((experience == 1) & ~F.coalesce(dated, F.lit(False)), 5).otherwise(0)
    return F.least(F.greatest(total - F.when(fallback, 20).otherwise(0), F.lit(0)), F.lit(100))


# --- tiers and scores ---------------------------------------------------------------------------------------


def experience_score(have: Column, wanted: Column) -> Column:
    h, w = F.coalesce(have, F.lit(0)), F.coalesce(wanted, F.lit(0))
    gap = h - w
    return F.when(w == 0, 70.0).when(gap == 0, 100.0).when(gap.between(1, 2), 95.0).when(gap.between(3, 5), 90.0).when(gap > 5, 85.0).when(gap >= -1, 80.0).when(gap >= -2, 60.0).when(gap >= -3, 40.0).otherwise(20.0)


def skill_score(matched_required: Column, required: Column, matched_nice: Column, nice: Column, distinct_skills: Column) -> Column:
    """70 points for required skills, 30 for nice ones, up to 10 for further skills, at most 100, to two decimals; 50 where none is required."""
    base = matched_required / required * 70.0 + F.when(nice > 0, matched_nice / nice * 30.0).otherwise(0.0)
    bonus = F.greatest(F.lit(0), F.least(F.lit(10), (distinct_skills - required) * 2))
    return F.when(required == 0, 50.0).otherwise(F.round(F.least(F.lit(100.0), base + bonus), 2))


def overall(skill: Column, experience: Column, project: Column, domain: Column) -> Column:
    w = L.DIMENSION_WEIGHTS
    return skill * w["skill"] + experience * w["experience"] + project * w["project"] + domain * w["domain"]


def cents(score: Column) -> Column:
    """score to two decimals, halves up whatever the last bit of the sum."""
    return F.floor(score * 100 + 0.50000001) / 100


def project_score(relevant: Column, projects: Column) -> Column:
    """Share of relevant projects in percent; 30 without projects."""
    return F.when(F.coalesce(projects, F.lit(0)) == 0, 30.0).otherwise(F.round(F.coalesce(relevant, F.lit(0)) * 100.0 / projects, 2))


def confidence_tier(unrounded: Column) -> Column:
    return F.when(unrounded >= 80, "high").when(unrounded >= 60, "medium").otherwise("low")


def recommendation(score: Column) -> Column:
    return F.when(score >= 60, "Moderate Match").otherwise("Weak Match")


def quality_tier(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 50, "moderate").otherwise("low")


def may_match(score: Column) -> Column:
    """The quality gate: unknown or at least 80."""
    return score.isNull() | (score >= 80)


def seniority(years: Column, leads: Column) -> tuple[Column, Column]:
    """(level, confidence) by years, raised by a leadership title."""
    level = F.when(years == 0, "intern").when(years < 2, "junior").when(years < 5, "mid").when(years < 8, "senior").when(years < 12, "lead").otherwise("principal")
    sure = F.when(years == 0, 0.9).when(years < 2, 0.85).when(years < 5, 0.8).when(years < 8, 0.75).when(years < 12, 0.7).otherwise(0.65)
    raised = F.when(leads & (years >= 10), "principal").when(leads & (years >= 8), "lead").when(leads & (years >= 5), "senior").otherwise(level)
    return raised, F.when(leads, F.least(F.lit(0.95), sure + 0.1)).otherwise(sure)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def json_in_text(text: Column) -> Column:
    """The JSON object in a model's reply: from the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
