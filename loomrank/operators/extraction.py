"""Structured facts of a document: validation of an extractor's output, and extraction by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions import vocab as V

EXTRACTED = "struct<candidate_name:string,skills:array<string>,experience:array<struct<role:string,type:string,duration_years:double>>,education:array<string>,projects:array<string>,semantic_summary:string>"


def validated(df: DataFrame, column: str) -> DataFrame:
    """Adds name, skills, experience_years, experience_breakdown, education, projects, semantic_summary from the struct; a null struct gives empty ones."""
    s = F.col(column)
    none = F.array().cast("array<string>")

    def trimmed(k: str):
        return F.coalesce(F.transform(F.filter(s[k], lambda x: x.isNotNull()), lambda x: F.trim(x)), none)

    years = F.coalesce(F.aggregate(s["experience"], F.lit(0.0), lambda t, e: t + F.coalesce(e["duration_years"], F.lit(0.0))), F.lit(0.0))
    return df.select(
        "*", F.trim(F.coalesce(s["candidate_name"], F.lit(""))).alias("name"), trimmed("skills").alias("skills"), S.valid_years(years).alias("experience_years"),
        s["experience"].alias("experience_breakdown"), trimmed("education").alias("education"), trimmed("projects").alias("projects"), F.coalesce(s["semantic_summary"], F.lit("")).alias("semantic_summary"),
    )


def by_rules(df: DataFrame, text: str, words: list[str] = V.SKILL_WORDS) -> DataFrame:
    """Adds ``extracted``: skills by plain substrings, years before "experience"; no name, degrees or projects."""
    years = X.experience_years(F.col(text)).cast("double")
    one = F.struct(F.lit("unspecified").alias("role"), F.lit("full-time").alias("type"), years.alias("duration_years"))
    none = F.array().cast("array<string>")
    return df.withColumn(
        "extracted",
        F.struct(
            F.lit("").alias("candidate_name"), X.found_words(F.lower(text), words).alias("skills"), F.when(years > 0, F.array(one)).otherwise(F.filter(F.array(one), lambda _: F.lit(False))).alias("experience"),
            none.alias("education"), none.alias("projects"), F.lit("Extracted by rules.").alias("semantic_summary"),
        ),
    )
