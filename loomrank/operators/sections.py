"""Lines, sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import vocab as V


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos from 0, line)."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def sectioned(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds label (of header lines) and section: the label of the last header above, "other" before the first."""
    w = W.partitionBy(doc).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("label", X.header_label(F.col("line"))).withColumn("section", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("other")))


def line_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A chunk for each line with text that isn't a header: candidate_id, chunk_id, section, text."""
    rows = sectioned(lines(docs, doc, text), doc).where(F.col("label").isNull() & (F.trim("line") != ""))
    return rows.select(F.col(doc).alias("candidate_id"), F.concat_ws(":", F.col(doc).cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "section", F.col("line").alias("text"))


def sentences(c: Column) -> Column:
    parts = F.split(c, r"(?<=[.!?])\s+|\n+")
    return F.filter(parts, lambda s: F.trim(s) != "")


def sentence_windows(c: Column, window: int = 3, overlap: int = 1) -> Column:
    """Windows of sentences joined by spaces, each ``window - overlap`` further on."""
    s = sentences(c)
    step = max(1, window - overlap)
    starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(s, i, F.lit(window)), " "))


def merged_pieces(pieces: Column, most: int = V.CHUNK_TOKENS) -> Column:
    """Greedy merge of neighbouring pieces up to ``most`` white-space tokens; a longer piece is cut first. One fold over the array, no Python."""
    words = F.transform(pieces, lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    cut = F.flatten(F.transform(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.slice(w, i * most + 1, F.lit(most))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))
    fold = F.aggregate(
        cut, start,
        lambda a, w: F.when(F.size(a["now"]) + F.size(w) <= most, F.struct(a["done"].alias("done"), F.concat(a["now"], w).alias("now"))).otherwise(F.struct(F.concat(a["done"], F.array(F.array_join(a["now"], " "))).alias("done"), w.alias("now"))),
        lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]),
    )
    return F.filter(fold, lambda s: s != "")


def column_split(words: DataFrame, page: list[str]) -> DataFrame:
    """words(page..., x0): where a page splits into two columns; null for one column.

    The widest gap between neighbouring x0 (the first of equal ones) counts if it is at least COLUMN_GAP
    and COLUMN_TOKENS words lie strictly left and right of its edges.
    """
    w = W.partitionBy(*page).orderBy("x0")
    gaps = words.select(*page, "x0", F.lead("x0").over(w).alias("next")).withColumn("gap", F.col("next") - F.col("x0"))
    widest = gaps.groupBy(*page).agg(F.max_by(F.struct("x0", "next", "gap"), F.struct("gap", -F.col("x0"))).alias("g"))
    sides = words.join(widest, page).groupBy(*page, "g").agg(F.count_if(F.col("x0") < F.col("g.x0")).alias("left"), F.count_if(F.col("x0") > F.col("g.next")).alias("right"))
    two = (F.col("g.gap") >= V.COLUMN_GAP) & (F.col("left") >= V.COLUMN_TOKENS) & (F.col("right") >= V.COLUMN_TOKENS)
    return sides.select(*page, F.when(two, (F.col("g.x0") + F.col("g.next")) / 2).alias("split"))


def coverage(chunks: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """chunks(doc, char_start, char_end) against docs(doc, text): chunk_count, coverage, warned (below COVERAGE_FLOOR)."""
    spans = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.col("char_end") - F.col("char_start")).alias("covered"))
    out = docs.join(spans, doc, "left").select(doc, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce(F.col("covered") / F.nullif(F.length("text"), F.lit(0)), F.lit(0.0)).alias("coverage"))
    return out.withColumn("warned", F.col("coverage") < V.COVERAGE_FLOOR)
