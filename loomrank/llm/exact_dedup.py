"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_of

#: Every run of these characters counts as one space.
WHITE = r"[\x20\x09-\x0D]+"
DIGEST = ["text_sha256", "check", "bytes"]


def merged_runs(digests: DataFrame, fan_in: int = 8) -> DataFrame:
    """Merges runs of (run, digest..., doc_id) in rounds until one run is left: (digest..., keep_id, group_size).

    A round sends the runs of ``fan_in`` neighbours to the same place, where rows of equal digest become
    one row with the smallest id and the summed count. The number of runs falls by ``fan_in`` each round,
    and so does what a later round has to move for a digest that many partitions hold.
    """
    runs = digests.agg(F.max("run")).first()[0]
    now = digests.groupBy("run", *DIGEST).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    left = 0 if runs is None else int(runs)
    while left > 0:
        left //= fan_in
        now = now.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *DIGEST).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return now.drop("run")


def exact_dedup(docs: DataFrame, text: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run has become one space (no trim); a null
    text is empty. Equality is verified at every merge by SHA-256, a second 64-bit hash and the length
    together. The row with the smallest doc_id stays; a repeated doc_id counts once for each row, and a
    null doc_id never wins over a real one. An empty table gives an empty result; columns of ``docs``
    other than doc_id and the text are ignored, whatever their names.
    """
    flat = F.regexp_replace(text_of(docs, text), WHITE, " ")
    digests = docs.select(docs["doc_id"].alias("doc_id"), flat.alias("flat"), F.spark_partition_id().cast("long").alias("run")).select(
        "doc_id", "run", F.sha2("flat", 256).alias("text_sha256"), F.xxhash64("flat").alias("check"), F.octet_length("flat").alias("bytes")
    )
    digests = staged(digests, "exact-digests")
    groups = staged(merged_runs(digests, fan_in).where("group_size > 1"), "exact-groups")
    return digests.join(groups, DIGEST, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
