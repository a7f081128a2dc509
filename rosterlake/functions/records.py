"""Column expressions over parsed records: entry fields, completeness, layout confidence, arbitration, cleaned skills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .columns import any_of, let


def filled(*fields: Column) -> Column:
    """The first field that is neither null, blank nor 'unknown'."""
    return F.coalesce(*[F.when((F.trim(f) != "") & (F.lower(F.trim(f)) != "unknown"), f) for f in fields])


def bullets(items: Column, otherwise: Column) -> Column:
    """Items as bullet lines, blank ones left out; without any, the other text, else empty."""
    kept = F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("• "), x))
    return F.coalesce(F.nullif(F.array_join(kept, "\n"), F.lit("")), filled(otherwise), F.lit(""))


def entry_fields(entry: Column) -> Column:
    """One shape for the variants of an experience entry; what no variant gives is 'N/A'."""
    end = F.coalesce(filled(entry["end_date"]), F.when(entry["is_current"], "Present"))
    named = {
        "title": filled(entry["role"], entry["title"], entry["position"]),
        "company": filled(entry["company"], entry["organization"]),
        "start_date": filled(entry["start_date"]),
        "end_date": end,
    }
    return F.struct(*[F.coalesce(c, F.lit("N/A")).alias(k) for k, c in named.items()], bullets(entry["responsibilities"], entry["description"]).alias("description"))


def completeness(identity: list[Column], experience: Column, education: Column, skills: Column, projects: Column, personality: Column) -> Column:
    """0 to 1: half a point for each identity field, capped points by counts, one for a confident personality; of ten."""
    counts = {"experience": experience, "education": education, "skills": skills, "projects": projects}
    points = sum([F.when(filled(f).isNotNull(), 0.5).otherwise(0.0) for f in identity], F.lit(0.0))
    for name, n in counts.items():
        each, most = L.COMPLETENESS[name]
        points = points + F.least(F.coalesce(n, F.lit(0)) * each, F.lit(most))
    return F.round((points + F.when(personality > 0.5, 1.0).otherwise(0.0)) / 10, 2)


def layout_confidence(columns: Column, sections: Column, spread: Column) -> Column:
    """Confidence from that of the column split, the mean one of the sections, and whether they lie in more than one column."""
    return F.least(F.lit(0.95), F.lit(0.5) + F.coalesce(columns * 0.3, F.lit(0.0)) + F.coalesce(sections * 0.4, F.lit(0.0)) + F.when(spread, 0.1).otherwise(0.0))


def prefer_refined(base: Column, refined: Column) -> Column:
    """Whether the refined parse replaces the base one: a weak base and a clear gain. A missing refined score never wins."""
    return F.coalesce((base < 70) & (refined > base + 10), F.lit(False))


def clean_skill(raw: Column) -> Column:
    """A skill's bare name: no lead-in, examples, brackets, years or alternatives; null for phrases and single letters."""
    text = F.trim(raw)

    def named(bare: Column) -> Column:
        phrase = bare.rlike(L.SKILL_PHRASE) & let(F.lower(bare), lambda low: ~any_of(low, L.SKILL_PHRASE_NAMES))
        name = F.regexp_replace(F.trim(F.regexp_replace(bare, L.SKILL_ALTERNATIVES, "")), "[.,;:]+$", "")
        return F.when(~phrase, let(name, lambda n: F.when((F.size(F.split(F.trim(n), r"\s+")) <= 3) & (F.length(n) >= 2), n)))

    bare = text
    for pattern in L.SKILL_NOISE:
        bare = F.regexp_replace(bare, pattern, "")
    return F.when(F.length(text) <= 35, let(bare, named))


def valid_skill(name: Column) -> Column:
    """Whether a cleaned name can be a skill: no number, stop word, company word or verb, and a technical look or one short word."""
    def bars(low: Column) -> Column:
        return low.rlike(r"^[\d./-]+$") | low.isin(L.SKILL_STOP_WORDS) | name.rlike(r"\b(?:19|20)\d{2}\s*[-–—]") | any_of(low, L.COMPANY_MARKS) | any_of(low, L.ACTION_VERBS)

    barred = let(F.lower(F.trim(name)), bars)
    looks = name.rlike(r"[A-Z./0-9]") & (F.length(name) <= 30) | name.rlike(r"^[a-z]{3,15}$")
    return F.coalesce(F.length(name).between(2, 50) & ~barred & looks, F.lit(False))


def company_forms(company: Column) -> Column:
    """A company's name in lower case, without its last word where that is a legal or trade word, and its first word; none for unknown names."""
    def forms(low: Column, words: Column) -> Column:
        short = F.when((F.size(words) > 1) & F.element_at(words, -1).isin(L.COMPANY_SUFFIXES), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        every = F.array(low, short, F.when(F.size(words) > 1, F.get(words, 0)))
        return F.when(low.isNotNull(), F.filter(every, lambda x: x.isNotNull() & (x != ""))).otherwise(F.array().cast("array<string>"))

    return let(F.lower(F.trim(filled(company))), lambda low: let(F.split(low, r"\s+"), lambda words: forms(low, words)))


def names_company(skill: Column, form: Column) -> Column:
    """Whether a skill holds a company's form, or, from four letters on, lies inside one."""
    return _low_names(F.lower(F.trim(skill)), form)


def _low_names(low: Column, form: Column) -> Column:
    return F.contains(low, form) | (F.length(low) >= 4) & F.contains(form, low)


def without_companies(skills: Column, companies: Column) -> Column:
    """Skills without those that name one of the companies, whose forms are worked out once a row."""
    every = F.array_distinct(F.flatten(F.transform(F.array_distinct(companies), lambda c: company_forms(c))))
    kept = lambda s, forms: let(F.lower(F.trim(s)), lambda low: ~F.exists(forms, lambda f: _low_names(low, f)))
    return let(every, lambda forms: F.filter(skills, lambda s: kept(s, forms)))


def explanation(n_required: Column, matched: Column, missing: Column, n_nice: Column, matched_nice: Column, years: Column, score: Column) -> tuple[Column, Column]:
    """(strengths, weaknesses), up to five sentences each; matched and missing are arrays, years the surplus over the demand."""
    def names(skills: Column) -> Column:
        return F.array_join(F.slice(skills, 1, 5), ", ")

    def say(key: str, *values: Column) -> Column:
        return F.format_string(L.EXPLANATIONS[key], *[v.cast("string") for v in values])

    rounded = F.round(score).cast("long")
    strong = [
        F.when(n_required > 0, say("required", F.size(matched), n_required)),
        F.when(n_nice > 0, say("nice", matched_nice)),
        F.when(F.size(matched) > 0, say("matched", names(matched))),
        F.when(years > 0, say("more_years", years)),
        F.when(score >= 70, say("strong", rounded)),
    ]
    weak = [
        F.when(F.size(missing) > 0, say("missing", F.size(missing), names(missing))),
        F.when(years < 0, say("fewer_years", -years)),
        F.when(score < 50, say("limited", rounded)),
    ]
    stated = F.filter(F.array(*strong), lambda x: x.isNotNull())
    return F.when(F.size(stated) > 0, stated).otherwise(F.array(F.lit(L.EXPLANATIONS["none"]))), F.filter(F.array(*weak), lambda x: x.isNotNull())
