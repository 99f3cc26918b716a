"""Concepts, requirements, verdicts, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..functions import text as X
from ..functions import vectors as Vec
from ..functions import vocab as V
from .search import small_side


def concept_lookup(skills: DataFrame, concepts: DataFrame, floor: float = V.CONCEPT_FLOOR) -> DataFrame:
    """skills(skill) with the nearest concept(preferred_label, alt_labels, concept_uri): label, alt_labels, similarity.

    A concept's text is its label and alternatives. Below the floor the skill stands for itself, without alternatives.
    """
    named = concepts.withColumn("text", F.concat_ws(" | ", "preferred_label", F.when(F.size("alt_labels") > 0, F.array_join("alt_labels", ", "))))
    a = Vec.bag_of_words(skills.select("skill").distinct(), ["skill"], "skill")
    named = named.groupBy("preferred_label").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))  # a label may be repeated
    b = Vec.bag_of_words(named, ["preferred_label"])
    best = Vec.sparse_cosine(a, ["skill"], small_side(b), ["preferred_label"]).groupBy("skill").agg(F.max_by(F.struct("preferred_label", "sim"), F.struct(F.col("sim"), -F.xxhash64("preferred_label").cast("double"))).alias("m"))
    best = best.where(F.col("m.sim") >= floor).select("skill", F.col("m.preferred_label").alias("preferred_label"), F.col("m.sim").alias("similarity")).join(concepts.select("preferred_label", "alt_labels"), "preferred_label")
    return skills.join(best, "skill", "left").select(*skills.columns, F.coalesce("preferred_label", "skill").alias("label"), F.coalesce("alt_labels", F.array().cast("array<string>")).alias("alt_labels"), "similarity")


def tiered(skills: DataFrame, jd_text: Column) -> DataFrame:
    """skills(skill, label) by keyword windows of the query document: required if the label stands in a required window, else preferred. Without any, the first ten are required."""
    hit = F.contains(F.lower(X.required_text(jd_text)), F.lower("label"))
    rows = skills.withColumn("hit", hit)
    any_hit = rows.agg(F.max("hit").alias("any"))
    place = F.row_number().over(W.orderBy("idx"))
    return rows.crossJoin(F.broadcast(any_hit)).withColumn("tier", F.when(F.col("hit") | (~F.col("any") & (place <= 10)), "required").otherwise("preferred")).withColumn("source", F.lit("keyword_fallback")).drop("hit", "any")


def deterministic_verdicts(spans: DataFrame, requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdict of each (requirement, candidate) by its best span score; pairs without a span are absent and cost no call."""
    best = spans.groupBy("query_id", "candidate_id").agg(F.max("ce_score").alias("best"), F.max_by("chunk_id", F.struct("ce_score", "chunk_id")).alias("chunk_id"))
    grid = candidates.select("candidate_id").crossJoin(small_side(requirements))
    verdict = S.verdict(F.coalesce("best", F.lit(0.0)))
    return grid.join(best, ["query_id", "candidate_id"], "left").select(*requirements.columns, "candidate_id", "best", verdict.alias("verdict"), F.when(F.col("best").isNotNull() & (verdict != "absent"), F.array("chunk_id")).otherwise(F.array().cast("array<string>")).alias("cited_chunk_ids"))


def validate_citations(proposed: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """proposed(keys..., candidate_id, verdict, cited_chunk_ids, quote) against spans(candidate_id, chunk_id, text).

    Invalid: a cited chunk that isn't a span of the candidate, or a quote that no cited chunk has verbatim
    (case and spaces aside). Such a verdict becomes claimed_only without quote; ``rejected`` says so.
    """
    flat = X.squash(F.lower("text"))
    known = spans.select("candidate_id", F.col("chunk_id").alias("cited"), flat.alias("body"), F.lit(True).alias("known"))
    rows = proposed.select(*keys, "candidate_id", "quote", F.explode("cited_chunk_ids").alias("cited")).join(known, ["candidate_id", "cited"], "left")
    quoted = F.contains("body", X.squash(F.lower("quote")))
    checked = rows.groupBy(*keys, "candidate_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.max(F.coalesce(quoted, F.lit(False))).alias("verbatim"))
    bad = (F.coalesce("unknown", F.lit(0)) > 0) | ((F.coalesce("quote", F.lit("")) != "") & ~F.coalesce("verbatim", F.lit(False)))
    out = proposed.join(checked, [*keys, "candidate_id"], "left").withColumn("rejected", bad)
    return out.select(*keys, "candidate_id", F.when(F.col("rejected"), "claimed_only").otherwise(F.col("verdict")).alias("verdict"), "cited_chunk_ids", F.when(~F.col("rejected"), F.col("quote")).alias("quote"), "rejected")


def aggregate_verdicts(requirements: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """evidence = sum(tier * value)/sum(tier), required_skills = share of tier weight that isn't absent; of double verdicts the last by ``seq`` counts, a missing one is absent."""
    last = verdicts.groupBy("candidate_id", "skill_name").agg(F.max_by("verdict", "seq").alias("verdict"))
    grid = candidates.select("candidate_id").crossJoin(small_side(requirements.select("skill_name", F.when(F.col("tier") == "required", 1.0).otherwise(V.PREFERRED_RATIO).alias("w"))))
    v = grid.join(last, ["candidate_id", "skill_name"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("absent")))
    return v.groupBy("candidate_id").agg((F.sum(F.col("w") * S.verdict_value(F.col("verdict"))) / F.sum("w")).alias("evidence"), (F.sum(F.when(F.col("verdict") != "absent", F.col("w")).otherwise(0.0)) / F.sum("w")).alias("required_skills"))


def span_signals(spans: DataFrame, requirements: DataFrame, candidates: DataFrame, scale: float = float(V.DENSE_K)) -> DataFrame:
    """semantic = mean over requirements of the mean fused score of its spans times ``scale``; reranker = the same of pair scores. No span counts as 0."""
    per = spans.groupBy("query_id", "candidate_id").agg((F.avg("fused_score") * scale).alias("sem"), F.avg("ce_score").alias("ce"))
    n = requirements.agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("candidate_id").agg(F.sum("sem").alias("sem"), F.sum("ce").alias("ce"))
    return candidates.select("candidate_id").join(sums, "candidate_id", "left").crossJoin(F.broadcast(n)).select("candidate_id", (F.coalesce("sem", F.lit(0.0)) / F.col("n")).alias("semantic"), (F.coalesce("ce", F.lit(0.0)) / F.col("n")).alias("reranker"))


def evidence_prompts(spans: DataFrame, keys: list[str], version: str = "1") -> DataFrame:
    """One prompt per candidate with its skills and their spans in order; deterministic."""
    per = spans.groupBy(*keys, "candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda s: F.concat(F.lit("  ["), s["chunk_id"], F.lit("] "), X.prompt_squash(s["text"]))), "\n").alias("body"))
    skill = F.concat(F.lit("- "), F.col(keys[0]).cast("string"), F.lit(":\n"), F.col("body"))
    body = per.groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(keys[0]).alias("k"), skill.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    head = f"Judge each skill by its evidence only (prompt {version}). Verdicts: demonstrated, claimed_only, absent. Cite chunk ids and an exact quote.\nCandidate: "
    return body.select("candidate_id", F.concat(F.lit(head), F.col("candidate_id").cast("string"), F.lit("\n"), F.col("body"), F.lit('\nAnswer with a JSON array of {"skill_name", "verdict", "cited_chunk_ids", "quote"}.')).alias("prompt"))


VERDICTS = "array<struct<skill_name:string,verdict:string,cited_chunk_ids:array<string>,quote:string>>"


def unwrapped(raw: Column) -> Column:
    """Verdicts in a model's answer: code fences off; an array as it is, of an object its first list that isn't empty; null if neither."""
    body = F.trim(F.regexp_replace(raw, r"(?m)^```(?:json)?\s*|```\s*$", ""))
    whole = F.from_json(body, VERDICTS)
    fields = F.from_json(body, f"map<string,{VERDICTS}>")
    first = F.get(F.filter(F.map_values(fields), lambda v: F.size(v) > 0), F.lit(0))
    return F.when(F.startswith(body, F.lit("[")), whole).otherwise(first)
