"""Column expressions over résumé texts: sections, entries, names, links, skill lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import automaton
from . import lexicons as L
from .columns import any_of, hits, let
from .records import clean_skill, filled, valid_skill  # noqa: F401


def some(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def section_pattern(section: str) -> str:
    """A section runs from a line that heads it to two blank lines, to a line that begins in capitals, or to the end."""
    return rf"(?is)(?:^|\n)(?:{L.SECTION_HEADS[section]})[:\s]+(.*?)(?:\n\n\n|\n(?-i:[A-Z]{{3,}})|\z)"


def section_text(text: Column, section: str) -> Column:
    return some(F.trim(F.regexp_extract(text, section_pattern(section), 1)))


def choose_text(column: Column, section: Column, mapped: Column, whole: Column) -> Column:
    """The text a section is read from: its column if over 50 characters, else the section if over 100, else the column it is mapped to, else all."""
    return F.coalesce(F.when(F.length(column) > 50, column), F.when(F.length(section) > 100, section), some(mapped), whole)


def filled_lines(entry: Column) -> Column:
    return F.filter(F.transform(F.split(entry, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def work_entry(entry: Column) -> Column:
    """(title, company, start_date, end_date, description) of a work entry.

    Dates come from the first line with a range. The company is the first other line that ends in a company's suffix, else
    what follows "at", "-" or "@" on the first line. The title is the first title in a line that is neither, else what
    stands before "at", "-" or "@". All other lines are the description.
    """
    def parts(ls: Column) -> Column:
        part = lambda n: F.trim(F.regexp_extract(F.get(ls, 0), L.TITLE_AT_COMPANY, n))
        dates = let(F.get(F.filter(ls, lambda x: x.rlike(L.ENTRY_RANGE)), 0), lambda d: F.struct(*[F.regexp_extract(d, L.ENTRY_RANGE, n).alias(k) for n, k in ((1, "start"), (2, "end"))]))
        return F.struct(F.get(ls, 0).alias("head"), F.filter(ls, lambda x: ~x.rlike(L.ENTRY_RANGE)).alias("other"), dates.alias("dates"), part(1).alias("before"), part(2).alias("after"))

    def named(p: Column) -> Column:
        suffixed = F.get(F.filter(p["other"], lambda x: x.rlike(L.ENTRY_COMPANY) & ~x.rlike(L.TITLE_AT_COMPANY)), 0)
        return let(suffixed, lambda s: let(F.filter(p["other"], lambda x: ~x.eqNullSafe(s)), lambda rest: titled(p, s, rest)))

    def titled(p: Column, suffixed: Column, rest: Column) -> Column:
        found = F.get(F.filter(F.transform(rest, lambda x: F.regexp_extract(x, L.ENTRY_TITLE, 0)), lambda x: x != ""), 0)
        return let(F.coalesce(some(p["before"]), found), lambda title: whole(p, suffixed, rest, title))

    def whole(p: Column, suffixed: Column, rest: Column, title: Column) -> Column:
        start, end = p["dates"]["start"], p["dates"]["end"]
        ended = F.when(F.upper(end).isin("PRESENT", "CURRENT", "NOW"), "present").otherwise(some(end))
        described = F.filter(rest, lambda x: ~x.eqNullSafe(title) & ~(x.eqNullSafe(p["head"]) & some(p["before"]).isNotNull()))
        return F.struct(title.alias("title"), F.coalesce(suffixed, some(p["after"])).alias("company"), some(start).alias("start_date"), ended.alias("end_date"), F.array_join(described, "\n").alias("description"))

    return let(let(filled_lines(entry), parts), named)


def years_of(entries: Column, year: int) -> Column:
    """Sum of the year differences of the entries that have a start date, an open end counting as year; null without one."""
    first = lambda date: F.nullif(F.regexp_extract(date, r"^\d{4}", 0), F.lit("")).cast("int")
    dated = F.filter(entries, lambda e: first(e["start_date"]).isNotNull())
    span = lambda e: F.greatest(F.coalesce(first(e["end_date"]), F.lit(year)) - first(e["start_date"]), F.lit(0))
    return let(dated, lambda es: F.when(F.size(es) > 0, F.aggregate(F.transform(es, span), F.lit(0), lambda a, b: a + b)))


def is_school(company: Column) -> Column:
    """Whether an entry's company is a place of education."""
    return F.coalesce(let(F.upper(company), lambda up: any_of(up, ["UNIVERSITY", "COLLEGE", "INSTITUTE", "SCHOOL", "ACADEMY"])), F.lit(False))


def pure_education(entry: Column) -> Column:
    """Education words and no work words."""
    return any_of(F.upper(entry), L.EDUCATION_WORDS) & ~any_of(F.upper(entry), L.WORK_WORDS)


def accepted(title: Column, company: Column) -> tuple[Column, Column]:
    """(whether an entry counts, its title): one with a company, or with a title that holds a job word and is no sentence; a bad title is 'Not Specified'."""
    sentence = F.coalesce(title.rlike(L.SENTENCE_TITLE) | (F.length(title) > 50), F.lit(False))
    good = F.coalesce((F.length(title) > 2) & any_of(F.upper(title), L.JOB_WORDS) & ~sentence, F.lit(False))
    return company.isNotNull() | good, F.when(title.isNull() | (sentence & company.isNotNull()), "Not Specified").otherwise(title)


def education_entry(entry: Column) -> Column:
    """(degree, institution, field, year): the first line with a degree, the first institution, what stands between, the first year."""
    def degree_of(ls: Column) -> Column:
        # no pattern holds a blank, so one that fits no part of the entry fits none of its lines
        first_like = lambda p: F.when(entry.rlike(p), F.get(F.filter(ls, lambda x: x.rlike(p)), 0))
        return F.coalesce(*[first_like(p) for p in L.DEGREES])

    def whole(s: Column) -> Column:
        degree, institution = s["degree"], some(s["institution"])
        after = F.substring(entry, F.call_function("instr", entry, degree) + F.length(degree), F.length(entry))
        between = let(after, lambda a: F.when(F.contains(a, institution), F.substring(a, F.lit(1), F.call_function("instr", a, institution) - 1)))
        field = let(F.regexp_replace(between, r"^[\s,–—-]+|[\s,–—-]+$", ""), some)
        return F.struct(degree.alias("degree"), institution.alias("institution"), field.alias("field"), some(s["year"]).alias("year"))

    place = F.when(any_of(entry, ["University", "College", "Institute", "School", "Academy"]), F.regexp_extract(entry, L.INSTITUTION, 0))
    told = F.struct(let(filled_lines(entry), degree_of).alias("degree"), place.alias("institution"), F.regexp_extract(entry, r"\b(?:19|20)\d{2}\b", 0).alias("year"))
    return let(told, whole)


def project_entry(entry: Column) -> Column:
    """(name, description, url, technologies): the first line names the project; null for summaries and names over 60 characters."""
    def found(ls: Column) -> Column:
        name = F.get(ls, 0)
        bad = (F.length(name) > 60) | F.lower(name).isin(L.SUMMARY_NAMES) | entry.rlike(L.SUMMARY_WORDS) & (F.length(entry) > 100) | (F.length(entry) < 10)
        used = let(F.lower(entry), lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in L.PROJECT_TECHNOLOGIES]), lambda x: x.isNotNull()))
        url = let(F.regexp_extract(entry, r"https?://[^\s]+", 0), some)
        whole = F.struct(name.alias("name"), F.array_join(F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(1)) - 1), "\n").alias("description"), url.alias("url"), used.alias("technologies"))
        return F.when(~bad & name.isNotNull(), whole)

    return let(filled_lines(entry), found)


def list_items(text: Column, shortest: int, longest: int) -> Column:
    """Items of a list by comma, semicolon, bullet or line, without what stands in brackets, of so many characters."""
    items = F.transform(F.split(text, r"[,;\n•]"), lambda x: F.trim(F.regexp_replace(x, r"\s*\([^)]+\)", "")))
    return F.filter(items, lambda x: F.length(x).between(shortest, longest))


def ordered_distinct(items: Column) -> Column:
    """items without those that an earlier one equals but for case, in order."""
    first = lambda low: F.filter(items, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)
    return let(F.transform(items, lambda x: F.lower(x)), first)


def entries_of(text: Column, pattern: str, least: int, read: Callable[[Column], Column]) -> Column:
    """(entry_no from 0, entry, e = read(entry)) of a text cut at the pattern, entries of fewer than least characters left out; null for a null text."""
    cut = F.transform(F.split(text, pattern), lambda x, i: F.struct(i.alias("entry_no"), F.trim(x).alias("entry")))
    return F.transform(F.filter(cut, lambda c: F.length(c["entry"]) >= least), lambda c: F.struct(c["entry_no"].alias("entry_no"), c["entry"].alias("entry"), read(c["entry"]).alias("e")))


def listed_skills(text: Column) -> Column:
    """Skills of a section: of each line that opens a category, with the lines up to the next; lines before the first are left out."""
    part = lambda m: F.when(m["c"].isNull(), m["x"]).otherwise(F.trim(F.regexp_replace(m["x"], "^[^:]+:", "")))

    def of(s: Column) -> Column:
        body = lambda at, k: F.array_join(F.slice(s["parts"], at + 1, F.coalesce(F.get(s["opens"], k + 1), F.size(s["parts"])) - at), " ")
        return F.flatten(F.transform(F.transform(s["opens"], body), lambda b: category_skills(b)))

    def placed(marked: Column) -> Column:
        opens = F.filter(F.transform(marked, lambda m, i: F.when(m["c"].isNotNull(), i)), lambda i: i.isNotNull())
        return F.struct(F.transform(marked, part).alias("parts"), opens.alias("opens"))

    marked = F.transform(filled_lines(text), lambda x: F.struct(x.alias("x"), category_of(x).alias("c")))
    return let(let(marked, placed), of)


def sort_ignoring_case(items: Column) -> Column:
    named = F.array_sort(F.transform(items, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.transform(named, lambda x: x["v"])


def category_of(line: Column) -> Column:
    """The category that a line opens: what stands before its colon, if short and no sentence."""
    fits = lambda n: (n != "") & (F.length(n) <= 25) & (F.size(F.split(n, r"\s+")) <= 3) & ~n.rlike(L.CATEGORY_BARRED)
    return F.when(line.contains(":"), let(F.trim(F.regexp_extract(line, r"^([^:]+):", 1)), lambda name: F.when(fits(name), name)))


def category_skills(text: Column) -> Column:
    """Cleaned, valid skills of a category's text, up to the first action verb."""
    kept = F.regexp_replace(F.trim(F.regexp_replace(text, L.CATEGORY_STOP, "")), "[.,;]+$", "")
    return F.filter(F.transform(F.split(kept, "[,;|/]"), lambda x: clean_skill(x)), lambda x: valid_skill(x))


def rule_skills(text: Column, words: list[str]) -> Column:
    """Lexicon words in the text, and the items of its skills section of over 2 characters."""
    known = automaton.found(F.lower(text), words)
    items = F.filter(F.transform(F.split(section_text(text, "skills"), r"[,;\n]"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return F.array_distinct(F.concat(known, F.coalesce(items, F.array().cast("array<string>"))))


def looks_like_name(line: Column) -> Column:
    """Two to four capitalised words of 2 to 15 letters, no contact data, title or section word."""
    t = F.trim(line)
    return t.rlike(r"^[A-Z][A-Za-z'.-]{1,14}(?:\s+[A-Z][A-Za-z'.-]{1,14}){1,3}$") & let(F.lower(t), lambda low: ~any_of(low, L.NAME_BARRED))


def url_kind(url: Column) -> Column:
    """linkedin, github, portfolio or other; null for mail hosts."""
    def kind(low: Column) -> Column:
        host = F.regexp_extract(low, r"^(?:https?://)?(?:www\.)?([^./]+)", 1)
        return F.when(low.contains("linkedin.com"), "linkedin").when(low.contains("github.com"), "github").when(host.isin(L.MAIL_HOSTS), F.lit(None)).when(any_of(low, L.OTHER_SITES), "other").otherwise("portfolio")

    return let(F.lower(url), kind)


def post_skills(text: Column, words: list[str]) -> tuple[Column, Column]:
    """(required, nice): lexicon words of a post's section of that kind, and those that follow "must" or "preferred" and the like on their line; sorted.

    Full-stack posts require html, css and rest api where they name them. Words after "must" count as whole words only. Section
    and line ends are cut out once a text, not once a word.
    """
    def named(s: Column) -> list[Column]:
        whole = lambda w: F.contains(s["after"], F.lit(w)) & s["after"].rlike(r"(?:^|[^a-z0-9_])" + _escaped(w) + r"(?:$|[^a-z0-9_])")
        return [F.when(F.contains(s["block"], F.lit(w)) | whole(w), w) for w in words]

    def implied(low: Column) -> list[Column]:
        full = low.rlike("full[ -]?stack")
        return [F.when(full & low.contains("html"), "html"), F.when(full & low.contains("css"), "css"), F.when(full & (low.contains("rest") | low.contains("api")), "rest api")]

    def listed(section: str, lead: str, more: Callable[[Column], list[Column]]) -> Column:
        def kept(s: Column) -> Column:
            return F.array_sort(F.array_distinct(F.filter(F.array(*named(s), *more(s["low"])), lambda x: x.isNotNull())))

        def parts(low: Column) -> Column:
            after = F.array_join(F.regexp_extract_all(low, F.lit(lead + r"([^\n]*)"), F.lit(1)), "\n")
            return F.struct(F.lower(F.regexp_extract(text, section, 1)).alias("block"), after.alias("after"), low.alias("low"))

        return let(let(F.lower(text), parts), kept)

    return listed(L.POST_REQUIRED, L.POST_MUST, implied), listed(L.POST_NICE, L.POST_MAY, lambda low: [])


def _escaped(word: str) -> str:
    return reduce(lambda w, c: w.replace(c, "\\" + c), ".+*?()[]{}|^$", word)


def first_line(text: Column, pattern: str) -> Column:
    """Number from 0 of the first line that the pattern fits, null without one; the pattern is read up to its first match and must not cross a line end."""
    return let(F.regexp_extract(text, rf"(?s)\A.*?(?:{pattern})", 0), lambda m: F.when(m != "", F.size(F.split(m, "\n")) - 1))


def content_starts(text: Column, low: Column, lines: Column) -> dict[str, Column]:
    """The line where each section of a text (low: in lower case) begins by what lines hold, null where it has none.

    experience begins at the first line with dates, a title, a company or a word of work, if two lines have dates, or one a title and one a
    company; education at a place or degree; skills at a list of technologies, or three of them; projects at a project's word beside a link.
    """
    in_line = lambda pattern: pattern.replace(r"[:\s]", r"(?:[^\S\n]|:)").replace(r"\s", r"[^\S\n]")
    any_word = lambda words: "|".join(_escaped(w) for w in words)
    upper, dates = F.upper(text), in_line(L.DATE_RANGE)
    title, company, listed = in_line(L.CONTENT_TITLES), in_line(L.CONTENT_COMPANIES), in_line(L.CONTENT_TECH_LIST)
    two_dates = F.size(F.filter(F.split(upper, "\n"), lambda x: x.rlike(dates))) >= 2
    work = F.least(first_line(upper, dates), first_line(text, title), first_line(text, company), first_line(low, any_word(L.CONTENT_WORK)))

    def first(flags: Column) -> Column:
        return let(F.array_position(flags, True), lambda at: F.when(at > 0, (at - 1).cast("int")))

    def skills(at: Column) -> Column:
        above = F.slice(lines, F.lit(1), F.coalesce(at, F.size(lines)))
        three = lambda x: hits(x, L.CONTENT_TECH) >= 3
        return F.least(at, F.when(three(low), first(F.transform(above, lambda x: let(F.lower(x), three)))))

    def linked(line: Column, small: Column) -> Column:
        may = line.contains("://") | small.contains("github.com/")
        return may & (line.rlike(r"https?://[^\s]+") | small.rlike(r"github\.com/[\w-]+/[\w-]+")) & any_of(small, L.CONTENT_PROJECT)

    project = first(F.transform(lines, lambda x: let(F.lower(x), lambda small: linked(x, small))))
    return {
        "experience": F.when(text.rlike(title) & text.rlike(company) | two_dates, work), "education": first_line(low, any_word(L.CONTENT_SCHOOL)),
        "skills": let(first_line(text, listed), skills), "projects": F.when(low.contains("://") | low.contains("github.com/"), project),
    }
