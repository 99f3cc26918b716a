"""Coverage of required skills by a candidate's skills: exact, and by best similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as Vec
from ..functions import vocab as V


def exact_coverage(df: DataFrame, required: str, own: str, heavy: int = 8) -> DataFrame:
    """Adds score (weights 2 for the first ``heavy`` requirements, 1 after), matched and missing in requirement order."""
    weights = F.transform(required, lambda _, i: F.when(i < heavy, 2.0).otherwise(1.0))
    have = F.transform(F.col(own), X.normal_skill)
    hit = F.transform(required, lambda s: F.array_contains(have, X.normal_skill(s)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    won = F.aggregate(F.zip_with(weights, hit, lambda w, h: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda a, w: a + w)
    score = F.when(F.size(required) == 0, 1.0).when(F.size(own) == 0, 0.0).otherwise(won / total)
    return df.select("*", score.alias("score"), F.filter(required, lambda s: F.array_contains(have, X.normal_skill(s))).alias("matched"), F.filter(required, lambda s: ~F.array_contains(have, X.normal_skill(s))).alias("missing"))


def skill_vectors(skills: DataFrame, column: str) -> DataFrame:
    """(skill, dim, v) of the distinct skills: each is embedded once, however many rows name it."""
    distinct = skills.select(F.col(column).alias("skill")).distinct()
    return Vec.bag_of_words(distinct, ["skill"], "skill")


def best_similarity(required: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """required(keys..., idx, skill) against own(keys..., skill): adds exact and best (largest cosine, 0 without any).

    Similarities are computed between distinct skill names, which are few, and joined back.
    """
    pairs = Vec.sparse_cosine(skill_vectors(required, "skill").withColumnRenamed("skill", "a"), ["a"], skill_vectors(own, "skill").withColumnRenamed("skill", "b"), ["b"])
    held = own.select(*keys, F.col("skill").alias("b")).distinct()
    near = required.join(pairs.withColumnRenamed("a", "skill"), "skill").join(held, [*keys, "b"]).groupBy(*keys, "idx").agg(F.max("sim").alias("best"), F.max(F.col("b") == F.col("skill")).alias("exact"))
    return required.join(near, [*keys, "idx"], "left").withColumns({"best": F.coalesce("best", F.lit(0.0)), "exact": F.coalesce("exact", F.lit(False))})


def semantic_coverage(scored: DataFrame, keys: list[str], floor: float = V.SKILL_FLOOR, accept: float = V.SKILL_ACCEPT, heavy: int | None = 8, inclusive: bool = False) -> DataFrame:
    """Weighted coverage of rows (keys..., idx from 0, skill, exact, best): score, matched, missing."""
    gain = F.when(F.col("exact"), 1.0).otherwise(F.least(F.greatest((F.col("best") - floor) / (1 - floor), F.lit(0.0)), F.lit(1.0)))
    weight = F.lit(1.0) if heavy is None else F.when(F.col("idx") < heavy, 2.0).otherwise(1.0)
    hit: Column = F.col("exact") | ((F.col("best") >= accept) if inclusive else (F.col("best") > accept))
    rows = scored.select(*keys, "idx", "skill", (gain * weight).alias("gain"), weight.alias("weight"), hit.alias("hit"))

    def names(when: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("idx", "skill")))), lambda x: x["skill"])

    return rows.groupBy(*keys).agg((F.sum("gain") / F.sum("weight")).alias("score"), names(F.col("hit")).alias("matched"), names(~F.col("hit")).alias("missing"))
