"""A corpus pipeline: quality, lines, near duplicates, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomrank.llm.common import staged, table
from loomrank.llm.decontamination import keep_clean
from loomrank.llm.line_dedup import line_dedup
from loomrank.llm.mixing import mixed
from loomrank.llm.near_dedup import keep_representatives
from loomrank.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike, by shingles at every character, one stays, in the first document that has it."""
    return line_dedup(docs, every=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which the documents left are read, by source and slot."""
    return mixed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier and the fuzzy stages can't be put in SQL. Tests hold the operators of lines, near duplicates and
#: decontamination against brute force, and the pipeline's stages only to their columns and shrinking sets of ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
