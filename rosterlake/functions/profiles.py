"""Column expressions over profiles and replies: usable parses, flattened skills, constraints, prompts, inferred seniority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .columns import any_of

_NONE = "array<string>"


def listed(field: Column) -> Column:
    """A JSON field as a list: an array as it is, a scalar as its only item, all else as empty."""
    array = F.from_json(field, _NONE)
    text = F.trim(field)
    scalar = F.when((text != "") & ~text.rlike(r"^[\[{]") & (F.lower(text) != "null"), F.array(text))
    return F.coalesce(F.when(text.startswith("["), array), scalar, F.array().cast(_NONE))


def strictly_listed(field: Column) -> Column:
    """A JSON field that is an array, else an empty list."""
    return F.coalesce(F.when(F.trim(field).startswith("["), F.from_json(field, _NONE)), F.array().cast(_NONE))


def usable(name: Column, confidence: Column, experience: Column, skills: Column) -> Column:
    """Whether a parse found anything: a name, some confidence, experience or skills."""
    named = F.coalesce((F.trim(name) != "") & (F.lower(F.trim(name)) != "unknown"), F.lit(False))
    return named | (F.coalesce(confidence, F.lit(0.0)) > 0) | (F.size(experience) > 0) | (F.size(skills) > 0)


def percent(confidence: Column) -> Column:
    """A confidence of 0 to 1 as whole percent, cut off."""
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 1e-9).cast("int")


def merge_flags(first: Column, second: Column) -> Column:
    """Both lists' flags, each once, in order."""
    none = F.array().cast(_NONE)
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))


def violations(title: Column, text: Column, email: Column) -> Column:
    """What keeps a post from being stored: title of 1 to 255 characters, text of 50 or more, e-mail in shape where there is one."""
    checks = [
        F.when(~F.coalesce(F.length(title).between(1, 255), F.lit(False)), "title"),
        F.when(~F.coalesce(F.length(text) >= 50, F.lit(False)), "text"),
        F.when(email.isNotNull() & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def inferred_seniority(years: Column, titles: Column) -> Column:
    """Level by years, raised by a leadership title from 8 years on; mid where the years are not known."""
    level = F.when(years == 0, "intern").when(years < 2, "junior").when(years < 5, "mid").when(years < 8, "senior").when(years < 12, "lead").otherwise("principal")
    leads = any_of(F.lower(titles), L.LEADERSHIP_INFERRED)
    return F.when(years.isNull(), "mid").when(leads & (years >= 10), "principal").when(leads & (years >= 8), "lead").otherwise(level)


def reply_json(text: Column) -> Column:
    """The JSON of a reply: a fenced block first, else from the first { to the last }."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def match_prompt(job: Column, required: Column, nice: Column, years: Column) -> Column:
    """A short prompt that asks a model to score candidates for a job."""
    skills = F.array_join(F.slice(required, 1, 10), ", ")
    wish = F.when(F.size(nice) > 0, F.array_join(F.slice(nice, 1, 10), ", ")).otherwise("none")
    return F.format_string("Job %s asks for: %s. Nice to have: %s. Years: %s. Reply with JSON.", job, skills, wish, F.coalesce(years.cast("string"), F.lit("not stated")))
