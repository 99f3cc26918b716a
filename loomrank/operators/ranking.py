"""Final ranking and its explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def explained(name: Column, score: Column, matched: Column, missing: Column, years: Column) -> Column:
    gaps = F.when(F.size(missing) > 0, F.concat(F.lit("Gaps identified in: "), F.array_join(missing, ", "), F.lit("."))).otherwise(F.lit("Closely matches all key required skills."))
    shown = F.when(F.size(matched) > 0, F.array_join(matched, ", ")).otherwise(F.lit("relevant skills"))
    has = F.when(F.coalesce(years, F.lit(0.0)) != 0, F.concat(F.lit("Has "), F.format_string("%.1f", years), F.lit(" years of professional experience. "))).otherwise(F.lit(""))
    return F.concat(name, F.lit(" scored "), F.format_string("%.3f", score), F.lit(". Demonstrates expertise in "), shown, F.lit(", aligning with the JD. "), has, gaps)


def explained_short(name: Column, score: Column, matched: Column, missing: Column) -> Column:
    """The variant that names three strengths and two gaps."""
    shown = F.when(F.size(matched) > 0, F.array_join(F.slice(matched, 1, 3), ", ")).otherwise(F.lit("relevant skills"))
    gaps = F.when(F.size(missing) > 0, F.concat(F.lit("However, they lack experience in "), F.array_join(F.slice(missing, 1, 2), ", "), F.lit(", which could be improved."))).otherwise(F.lit("They closely match all key required skills."))
    return F.concat(name, F.lit(" is a strong candidate with a score of "), score.cast("string"), F.lit(". They demonstrate expertise in "), shown, F.lit(", which aligns well with the job requirements. "), gaps)


def ranked(df: DataFrame, score: str, tie: str, keys: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Adds rank from 1 by falling score, ties by ``tie``. Within ``keys`` by a window; without, the ranks come from a range-partitioned sort, not from one task."""
    if keys:
        out = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie)))
        return out.where(F.col("rank") <= k) if k else out
    if k:
        return df.orderBy(F.desc(score), tie).limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), tie)))
    # rows above in other score buckets, plus the place within the own bucket
    bucket = F.floor(F.coalesce(F.col(score), F.lit(0.0)) * 10000)
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    above = sizes.withColumn("_above", F.sum("_n").over(W.orderBy(F.desc("_b"))) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy("_b").orderBy(F.desc(score), tie))
    return b.join(above, "_b").withColumn("rank", (F.col("_above") + place).cast("int")).drop("_b", "_above")
