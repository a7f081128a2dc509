"""Jobs over parsed records: re-parsing what changed, gap-filling, company names among skills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import company_forms as forms_of
from ..functions.records import filled, names_company


def reparse_changed(base: DataFrame, patch: DataFrame, key: str, text: str, derived: list[str], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """base with the patch's texts; parse runs on rows whose text changed, the rest keep their derived columns.

    patch holds one row a key; a null text in it changes nothing. parse adds the derived columns to (key, text).
    """
    new = patch.select(key, F.col(text).alias("_new"))
    joined = base.join(new, key, "left")
    differs = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(text))
    fresh = parse(joined.filter(differs).select(key, F.col("_new").alias(text))).select(key, text, *derived)
    kept = joined.filter(~differs).select(key, text, *derived)
    return kept.withColumn("changed", F.lit(False)).unionByName(fresh.withColumn("changed", F.lit(True)))


def fill_gaps(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """first's rows, each blank or unknown field taken from the second's row of that key, else null."""
    other = second.select(key, *[F.col(c).alias(f"_2_{c}") for c in fields])
    return first.join(other, key, "left").select(key, *[filled(F.col(c), F.col(f"_2_{c}")).alias(c) for c in fields])


def company_forms(companies: DataFrame, owner: str, company: str) -> DataFrame:
    """(owner, form): the forms of each owner's companies, see functions.records."""
    return companies.select(owner, F.explode(forms_of(F.col(company))).alias("form")).distinct()


def drop_company_skills(skills: DataFrame, companies: DataFrame, owner: str, skill: str, company: str) -> DataFrame:
    """Skills that are no company of their owner: not one of its forms, nor inside one (from four letters), nor holding one."""
    forms = company_forms(companies, owner, company).withColumnRenamed(owner, "_owner")
    return skills.join(forms, (F.col(owner) == F.col("_owner")) & names_company(F.col(skill), F.col("form")), "left_anti")
