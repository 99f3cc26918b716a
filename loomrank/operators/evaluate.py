"""Quality metrics of retrieval and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocab as V

ORDER = {"absent": 0, "claimed_only": 1, "demonstrated": 2}


def confidence(v: str):
    return F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col(v))


def recall_at_k(gold: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """gold(keys..., chunk_id) against top(config, keys..., chunk_id): hits, pairs and recall per config."""
    pairs = gold.agg(F.count(F.lit(1)).alias("pairs"))
    named = gold.select(*keys, "chunk_id").distinct().withColumn("_hit", F.lit(1))
    hits = top.join(named, [*keys, "chunk_id"], "left").groupBy("config").agg(F.count("_hit").alias("hits"))
    return hits.crossJoin(F.broadcast(pairs)).select("config", "hits", "pairs", (F.col("hits") / F.nullif("pairs", F.lit(0))).alias("recall"))


def citation_validity(runs: DataFrame) -> DataFrame:
    """runs(run, proposed, rejected): the share not rejected, null without proposals."""
    return runs.groupBy("run").agg(F.sum("proposed").alias("proposed"), F.sum("rejected").alias("rejected")).withColumn("validity", (F.col("proposed") - F.col("rejected")) / F.nullif("proposed", F.lit(0)))


def accuracy(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy overall (gold class "all") and by gold class; a missing prediction is absent."""
    both = gold.join(predicted, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("absent")))
    return both.rollup("v").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == F.col("verdict")).cast("int")).alias("accuracy")).withColumn("v", F.coalesce("v", F.lit("all")))


def false_missing(gold: DataFrame, predicted: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """By candidate: demonstrated pairs of the gold set, those predicted as something else, and their share."""
    both = gold.where(F.col("v") == "demonstrated").join(predicted, keys, "left")
    return both.groupBy(candidate).agg(F.count(F.lit(1)).alias("demonstrated"), F.count_if(F.coalesce("verdict", F.lit("absent")) != "demonstrated").alias("missed")).withColumn("rate", F.col("missed") / F.col("demonstrated"))


def alias_grid(alias: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The most confident verdict among a requirement's alias skills; none is absent."""
    pairs = alias.select("r", F.explode_outer("skills").alias("skill")).crossJoin(candidates)
    best = pairs.join(verdicts, ["skill", "c"], "left").groupBy("r", "c").agg(F.max_by("verdict", confidence("verdict")).alias("verdict"))
    return best.withColumn("verdict", F.coalesce("verdict", F.lit("absent")))


def kendall_tau(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tau-a of (keys..., item, a, b) rank pairs; ties count as discordant, fewer than two items give 0."""
    x, y = pairs.select(*keys, F.col("item").alias("i"), F.col("a").alias("ai"), F.col("b").alias("bi")), pairs.select(*keys, F.col("item").alias("j"), F.col("a").alias("aj"), F.col("b").alias("bj"))
    both = x.join(y, keys).where("i < j").groupBy(*keys).agg(F.count_if((F.col("ai") - F.col("aj")) * (F.col("bi") - F.col("bj")) > 0).alias("concordant"), F.count(F.lit(1)).alias("all"))
    return pairs.select(*keys).distinct().join(both, keys, "left").select(*keys, F.coalesce((2.0 * F.col("concordant") - F.col("all")) / F.col("all"), F.lit(0.0)).alias("tau"))


def sweep(best: DataFrame, gold: DataFrame, keys: list[str], demonstrated: list[float], claimed: list[float]) -> DataFrame:
    """Accuracy and demonstrated recall for each pair of thresholds claimed < demonstrated, and their place by falling accuracy, then recall."""
    spark = best.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).alias("demo"), F.lit(c).alias("claim")) for d in demonstrated for c in claimed if c < d])).alias("g")).select("g.*")
    both = gold.join(best, keys, "left").crossJoin(F.broadcast(grid))
    v = F.when(F.coalesce("ce", F.lit(0.0)) > F.col("demo"), "demonstrated").when(F.coalesce("ce", F.lit(0.0)) > F.col("claim"), "claimed_only").otherwise("absent")
    out = both.withColumn("hit", (F.col("v") == v).cast("int")).groupBy("demo", "claim").agg(F.avg("hit").alias("accuracy"), F.avg(F.when(F.col("v") == "demonstrated", F.col("hit"))).alias("recall"))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), F.desc("recall"), "demo", "claim")))


def evidence_ranking(verdicts: DataFrame) -> DataFrame:
    """Candidates by demonstrated, then claimed verdicts, then id."""
    n = verdicts.groupBy("c").agg(F.count_if(F.col("verdict") == "demonstrated").alias("demonstrated"), F.count_if(F.col("verdict") == "claimed_only").alias("claimed"))
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("demonstrated"), F.desc("claimed"), "c")))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.withColumnRenamed("tier", "ta").join(b.withColumnRenamed("tier", "tb"), keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ta") == F.col("tb")).cast("int")).alias("agreement"))


def gold_checks(labels: DataFrame, requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Problems of a gold set by kind: unknown verdicts, double labels, pairs without a label, demonstrated rows without a quote."""
    pairs = requirements.crossJoin(candidates)
    kinds = {
        "unknown_verdict": labels.where(~F.coalesce(F.col("v").isin(list(V.VERDICT_VALUES)), F.lit(False))),
        "double_label": labels.groupBy("r", "c").count().where("count > 1"),
        "missing_pair": pairs.join(labels, ["r", "c"], "left_anti"),
        "no_quote": labels.where((F.col("v") == "demonstrated") & (F.coalesce("quote", F.lit("")) == "")),
    }
    out = None
    for k, df in kinds.items():
        row = df.agg(F.lit(k).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
