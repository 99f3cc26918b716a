"""Tables in place of stores: points, response cache, call budget, ingest status, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X


def matches(filters: dict) -> Column:
    """All conditions hold: a scalar by equality, a list by membership; null doesn't match; no condition always holds."""
    out = F.lit(True)
    for k, v in filters.items():
        out = out & F.coalesce(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v), F.lit(False))
    return out


def upserted(points: DataFrame, new: DataFrame, size: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """The points after ``new`` (with seq) came: the last write of an id wins; a vector of another size raises an error."""
    both = points.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    both = both.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {size} values: id "), F.col(id).cast("string")))))
    rest = [c for c in points.columns if c != id]
    return both.groupBy(id).agg(F.max_by(F.struct(*rest), "seq").alias("_p")).select(id, *[F.col(f"_p.{c}").alias(c) for c in rest])


def deleted(points: DataFrame, filters: dict) -> DataFrame:
    return points.where(~matches(filters))


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with response, misses); a null response counts as a miss."""
    good = cache.where(F.col("response").isNotNull()).dropDuplicates([key])
    return requests.join(good, key), requests.join(good, key, "left_anti")


def within_budget(misses: DataFrame, job: str, order: str, budget: int) -> DataFrame:
    """Adds blocked: calls beyond the job's budget, in order; 0 is no limit."""
    if budget == 0:
        return misses.withColumn("blocked", F.lit(False))
    return misses.withColumn("blocked", F.row_number().over(W.partitionBy(job).orderBy(order)) > budget)


def usage(log: DataFrame) -> DataFrame:
    """Calls, hits, blocked, tokens and time of a call log by operation."""
    return log.groupBy("op").agg(F.count_if(~F.col("hit") & ~F.col("blocked")).alias("calls"), F.count_if("hit").alias("hits"), F.count_if("blocked").alias("blocked"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("latency_ms").alias("latency_ms"))


def deduped_uploads(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row per content: candidate_id and the first upload by ``order``, with the number of uploads."""
    return docs.groupBy(X.content_id(F.coalesce(text, F.lit(""))).alias("candidate_id")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("uploads"))


def scorable(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "done")
