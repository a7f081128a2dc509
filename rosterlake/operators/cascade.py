"""Parsers of résumé texts in turn: each runs only on what those before it left unusable, and the parse becomes a full stored record."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..functions import profiles as P
from ..functions import records as N
from ..functions import resumes as T
from ..sources.work import work_table
from . import resumes as R

#: What a parser gives, whichever it is.
PARSED = {
    "experience": "array<struct<title:string,company:string,start_date:string,end_date:string,description:string>>",
    "education": "array<struct<degree:string,institution:string,field:string,year:string>>",
    "projects": "array<struct<name:string,description:string,url:string,technologies:array<string>>>",
    "skills": "array<string>", "certifications": "array<string>", "languages": "array<string>",
}


def in_turn(rows: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], usable: Column) -> DataFrame:
    """rows with the columns of the first stage whose parse is usable, and parser, that stage's name.

    A stage gets the rows that no earlier one could use and returns each of them once with its columns added; all stages add
    the same columns. Rows that no stage can use have the last one's columns and parser 'none'. A parse is written once, as
    both its usable and its other rows are read.
    """
    done, rest = [], rows
    for name, parse in stages.items():
        parsed = work_table(parse(rest).withColumn("_usable", F.coalesce(usable, F.lit(False))), f"parsed-{name}")
        done.append(parsed.filter("_usable").withColumn("parser", F.lit(name)))
        rest = parsed.filter("NOT _usable").select(*rows.columns)
    done.append(parsed.filter("NOT _usable").withColumn("parser", F.lit("none")))
    return reduce(DataFrame.unionByName, done).drop("_usable")


def _with_lists(rows: DataFrame) -> DataFrame:
    """rows with every list of a parse in its type, empty where a parser has none."""
    return rows.withColumns({n: F.coalesce(F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind), F.array().cast(kind)) for n, kind in PARSED.items()})


def section_lists(bodies: dict[str, Column]) -> dict[str, Column]:
    """experience, education, projects and skills from the texts of these sections, entries in their order; empty for a null text.

    A section is read within its own row, each entry once, so entries are neither shuffled nor sorted.
    """
    def works(w: Column) -> Column:
        e = w["e"]
        return e["company"].isNotNull() & (e["title"].isNotNull() | e["start_date"].isNotNull()) & ~T.is_school(e["company"])

    def school(w: Column) -> Column:
        return F.struct(*[F.coalesce(w["e"][n], F.lit("Unknown")).alias(n) for n in ("degree", "institution")], w["e"]["field"].alias("field"), w["e"]["year"].alias("year"))

    def of_work(entry: Column) -> Column:
        return F.when(C.let(F.upper(entry), lambda up: ~C.any_of(up, L.EDUCATION_WORDS)), T.work_entry(entry))

    read = lambda s, pattern, least, how: T.entries_of(bodies[s], pattern, least, how)
    schools = F.filter(read("education", r"\n\s*\n|\n\s*[-•]\s*", 5, T.education_entry), lambda w: w["e"]["degree"].isNotNull() | w["e"]["institution"].isNotNull())
    return {
        "experience": F.transform(F.filter(read("experience", "\n\n+", 10, of_work), works), lambda w: w["e"]), "education": F.transform(schools, school),
        "projects": F.transform(F.filter(read("projects", "\n\n+", 10, T.project_entry), lambda w: w["e"].isNotNull()), lambda w: w["e"]),
        "skills": C.let(T.listed_skills(bodies["skills"]), T.ordered_distinct),
    }


def _with_sections(rows: DataFrame, bodies: dict[str, Column], more: dict[str, Column]) -> DataFrame:
    """rows with the lists of their sections, whose texts are cut out once."""
    names = {s: f"_{s}" for s in bodies}
    lists = section_lists({s: F.col(n) for s, n in names.items()})
    return _with_lists(rows.withColumns({names[s]: body for s, body in bodies.items()}).withColumns(lists | more)).drop(*names.values())


def by_headers(rows: DataFrame) -> DataFrame:
    """Rows with text and the lists of the sections that headers open."""
    text = F.col("text")
    more = {"certifications": T.list_items(T.section_text(text, "certifications"), 3, 49), "languages": T.list_items(T.section_text(text, "languages"), 2, 29)}
    return _with_sections(rows, {s: T.section_text(text, s) for s in ("experience", "education", "projects", "skills")}, more)


def by_content(rows: DataFrame) -> DataFrame:
    """Rows with text and the lists of sections told from what their lines hold, without headers."""
    body = lambda section: F.get(F.filter("_parts", lambda s: s["section"] == section), 0)["body"]
    return _with_sections(rows.withColumn("_parts", R.content_parts(F.col("text"))), {s: body(s) for s in L.CONTENT_ENDS}, {}).drop("_parts")


def by_rules(rows: DataFrame) -> DataFrame:
    """Rows with text and, as skills, the lexicon's words in it and the items of its skills section, sorted; no entries."""
    return _with_lists(rows.withColumn("skills", F.array_sort(T.rule_skills(F.col("text"), L.JOB_SKILLS))))


def parse_resumes(docs: DataFrame, text: str, year: int) -> DataFrame:
    """docs with parser and the columns of a stored record: identity, links, lists, years, completeness, quality and score.

    Texts are parsed by their headers, else by their lines' content, else by rules: a parse is usable if it has experience or
    skills. Equal texts are parsed once. Name, e-mail, phone and links come from the text, null where it has none (first and
    last name 'unknown'); skills that name a company of the same text go. years adds the year differences of the dated entries,
    an open end counting as year, and is null without a dated entry. completeness is 0 to 1, quality the same as whole percent,
    score the quality of the parse with its tier. Null and empty texts have parser 'none' and empty lists; text columns of docs
    are kept, columns of docs that are named like one of the record are replaced.
    """
    keyed = work_table(docs.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), "keyed")
    texts = work_table(keyed.groupBy("_hash").agg(F.coalesce(F.min(text), F.lit("")).alias("text")), "texts")
    stages = {"headers": by_headers, "content": by_content, "rules": by_rules}
    parsed = in_turn(texts, stages, (F.size("experience") > 0) | (F.size("skills") > 0))
    record = stored_record(parsed, year).drop("text")
    return keyed.drop(*[c for c in record.columns if c != "_hash"]).join(record, "_hash").drop("_hash")


def stored_record(parsed: DataFrame, year: int) -> DataFrame:
    """A parse (text, parser and the lists) as the record that is stored, see parse_resumes. Name and links are looked for once a row."""
    text, name, kinds_of_link = F.col("text"), F.col("_name"), ("linkedin", "github", "portfolio")
    named = F.trim(F.get(F.filter(F.slice(F.split(text, "\n", 6), 1, 5), lambda x: T.looks_like_name(x)), 0))
    first, last = C.split_name(name)
    # no link crosses a character that none can hold; runs without a dot are passed over, as the pattern is quadratic in them
    dotted = lambda words: F.filter(words, lambda x: x.contains("."))
    words = dotted(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    pieces = dotted(F.flatten(F.transform(words, lambda x: F.split(x, "[^a-zA-Z0-9_/.:-]+"))))
    urls = F.flatten(F.transform(pieces, lambda x: F.regexp_extract_all(x, F.lit(L.URL), F.lit(0))))
    links = F.transform(urls, lambda u: F.struct(u.alias("url"), T.url_kind(u).alias("kind")))
    link = lambda kind: F.get(F.filter("_links", lambda u: u["kind"] == kind), 0)["url"]
    found = parsed.withColumns({"_name": named, "_links": links, "email": C.first_email(text), "phone": C.first_phone(text)})
    said = found.withColumns({"first_name": first, "last_name": last, **{f"{k}_url": link(k) for k in kinds_of_link}})
    said = said.withColumns({f"{k}_url": C.normalize_url(F.col(f"{k}_url")) for k in kinds_of_link})
    companies = F.transform("experience", lambda e: e["company"])
    cleaned = said.withColumns({"skills": N.without_companies(F.col("skills"), companies), "years": T.years_of(F.col("experience"), year)})
    n = {k: F.size(k) for k in ("experience", "education", "projects", "skills")}
    full = N.completeness([name, F.col("email"), F.col("phone"), F.lit(None).cast("string")], n["experience"], n["education"], n["skills"], n["projects"], F.lit(None).cast("double"))
    dated = F.exists("experience", lambda e: F.coalesce(e["start_date"], e["end_date"]).isNotNull())
    kinds = reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in n.values()])
    layout = F.when(F.col("parser").isin("headers", "content"), 0.5).otherwise(0.0)
    score = C.parse_quality(n["skills"], F.col("years").isNotNull().cast("int"), n["experience"], n["education"], n["projects"], F.length(text), kinds, layout, layout == 0, dated)
    scored = cleaned.withColumns({"completeness": full, "score": score})
    return scored.withColumns({"quality": P.percent(F.col("completeness")), "tier": C.quality_tier(F.col("score")), "may_match": C.may_match(F.col("score"))}).drop("_name", "_links")
