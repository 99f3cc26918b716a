"""End-to-end plans: signals of every candidate against one query document, and the rankings made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..functions import text as X
from ..functions import vectors as Vec
from ..functions import vocab as V
from ..operators import coverage, evidence, ranking, search, sections
from .registry import lit, sql_list

JD_YEARS, JD_DEGREES, JD_PREFERRED = 4.0, ["bachelor of technology"], ["kafka", "aws"]
#: Characters of each text that the whole-document pair scorer sees: a property of that scorer.
PAIR_CHARS = 1200


def similarity_to(docs: DataFrame, query: str, ids: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "semantic") -> DataFrame:
    """``docs`` ids with the cosine of their bag of words and the query text's; only dimensions of the query are joined."""
    ids = list(ids)
    one = docs.sparkSession.range(1).select(F.lit(0).alias("_q"), F.lit(query).alias("text"))
    q = Vec.bag_of_words(one, ["_q"])
    sims = Vec.sparse_cosine(F.broadcast(q), ["_q"], Vec.bag_of_words(docs, ids, text), ids).drop("_q")
    return docs.select(*ids).join(sims, ids, "left").select(*ids, F.coalesce("sim", F.lit(0.0)).alias(out))


def projects_of(docs: DataFrame) -> DataFrame:
    """(doc_id, i, project) from the project section."""
    return docs.select("doc_id", F.posexplode(X.split_projects(X.section(F.col("text"), V.PROJECT_STARTS, V.PROJECT_ENDS))).alias("i", "project"))


def project_scores(docs: DataFrame, query: str) -> DataFrame:
    """projects = 0.5 best + 0.3 mean of the top three + 0.2 share above PROJECT_RELEVANT; project_best; n_projects; project_overlap."""
    rows = projects_of(docs)
    sims = similarity_to(rows, query, ("doc_id", "i"), "project", "sim").join(rows, ["doc_id", "i"])
    named = F.exists(F.split(F.lit(query), r"\s+"), lambda w: F.contains("project", w))
    sims = sims.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("sim"), "i")))
    out = sims.groupBy("doc_id").agg(
        F.max("sim").alias("project_best"), F.avg(F.when(F.col("place") <= 3, F.col("sim"))).alias("three"), F.avg((F.col("sim") > V.PROJECT_RELEVANT).cast("int")).alias("share"), F.count(F.lit(1)).alias("n_projects"), F.avg(named.cast("int")).alias("project_overlap")
    )
    out = out.select("doc_id", "project_best", "n_projects", "project_overlap", (0.5 * F.col("project_best") + 0.3 * F.col("three") + 0.2 * F.col("share")).alias("projects"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("project_best", "project_overlap", "projects")} | {"n_projects": F.coalesce("n_projects", F.lit(0))}
    return docs.select("doc_id").join(out, "doc_id", "left").withColumns(zero)


def signals(docs: DataFrame, query: str, query_skills: list[str], vocabulary: list[str]) -> DataFrame:
    """docs(doc_id, text) with every signal of the classic scorer, in columns named by signal."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", X.found_words(F.lower("text"), vocabulary).alias("own"), X.found_words(F.lower("text"), V.DEGREES, whole=True).alias("degrees"))
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(query_skills)], "idx int, skill string").withColumn("skill", X.normal_skill(F.col("skill")))
    required = docs.select("doc_id").crossJoin(F.broadcast(asked))
    cover = coverage.semantic_coverage(coverage.best_similarity(required, base.select("doc_id", F.explode("own").alias("skill")), ["doc_id"]), ["doc_id"])
    out = base.join(cover.select("doc_id", F.col("score").alias("required_skills"), "matched", "missing"), "doc_id").join(similarity_to(docs, query), "doc_id").join(project_scores(docs, query), "doc_id")
    ce = S.squashed(search.lexical_scorer(F.substring(F.lit(query), 1, PAIR_CHARS), F.substring("text", 1, PAIR_CHARS)))
    gate = (F.col("semantic") > V.GATE_SEMANTIC) | (F.col("required_skills") > V.GATE_SKILLS)
    out = out.withColumn("ce", ce).withColumn("years", S.valid_years(X.experience_years(F.col("text")).cast("double")))
    return out.select(
        "doc_id", "required_skills", "matched", "missing", "semantic", "ce", F.when(gate, F.col("ce")).otherwise(F.col("semantic") * V.GATE_FACTOR).alias("reranker"), "years",
        S.experience(F.lit(JD_YEARS), F.col("years")).alias("experience"), S.education(X.strings(JD_DEGREES), F.col("degrees")).alias("education"), "projects", "project_best", "project_overlap", "n_projects",
        S.evidence_share(F.col("matched"), F.col("text")).alias("evidence"), S.exact_share(X.strings(JD_PREFERRED), F.col("own")).alias("preferred_skills"),
    )


def legacy_score(s: DataFrame, jd_text: str, jd_years: float, has_education: bool) -> DataFrame:
    return s.withColumn("final_score", S.combined(S.adaptive(F.lit(jd_text), F.lit(jd_years), F.lit(has_education)), {k: F.col(k) for k in V.WEIGHTS}))


def weighted(s: DataFrame, percent: dict[str, float]) -> DataFrame:
    """The signals under a user's weights (percentages); scoring again needs only this step on kept signals."""
    return s.withColumn("final_score", S.combined(S.user_weights({k: S.num(percent[k]) for k in V.WEIGHTS}), {k: F.col(k) for k in V.WEIGHTS}))


def five_signals(s: DataFrame, w: dict[str, float] = V.WEIGHTS_V2) -> DataFrame:
    parts = {"skill": "required_skills", "semantic": "semantic", "project": "project_best", "education": "education", "experience": "experience"}
    return s.withColumn("final_score", S.combined({k: S.num(v) for k, v in w.items()}, {k: F.col(c) for k, c in parts.items()}))


def eight_signals(s: DataFrame) -> DataFrame:
    w = S.adaptive_eight(F.lit(True), F.lit(True), F.lit(True))
    return s.withColumn("final_score", S.combined(w, {k: F.col("project_best" if k == "projects" else k) for k in w}))


def candidates(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("candidate_id"))


def evidence_spans(chunks: DataFrame, strings: DataFrame) -> DataFrame:
    """Hybrid retrieval of each (requirement, candidate), reranked on the requirement's first string, above the floor."""
    first = strings.where("pos = 0").select("query_id", F.col("text").alias("query"))
    return search.rerank(search.hybrid(chunks, strings).join(search.small_side(first), "query_id"), "query", ["query_id", "candidate_id"])


def rag_parts(docs: DataFrame, strings: DataFrame, tiers: DataFrame) -> dict[str, DataFrame]:
    """spans, verdicts, verdict_signals and span_signals of every document. A failing document gives nulls, not an error."""
    spans, who = evidence_spans(sections.line_chunks(docs.select("doc_id", "text")), strings), candidates(docs)
    verdicts = evidence.deterministic_verdicts(spans, tiers, who)
    named = verdicts.select("candidate_id", F.col("query_id").cast("string").alias("skill_name"), "verdict", F.lit(0).alias("seq"))
    reqs = tiers.select(F.col("query_id").cast("string").alias("skill_name"), "tier")
    return {"spans": spans, "verdicts": verdicts, "verdict_signals": evidence.aggregate_verdicts(reqs, named, who), "span_signals": evidence.span_signals(spans, tiers, who)}


def evidence_detail(spans: DataFrame, verdicts: DataFrame, skill: int | None = None) -> DataFrame:
    out = spans.join(verdicts.select("query_id", "candidate_id", "verdict"), ["query_id", "candidate_id"])
    return out if skill is None else out.where(F.col("query_id") == skill)


def rag_weights() -> dict[str, float]:
    """The weights of ``rank_rag`` for a senior query document with years and a degree, as numbers."""
    w = dict(V.WEIGHTS_RAG)
    w["experience"], w["semantic"] = w["experience"] + 0.10, w["semantic"] - 0.10
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def rank_rag(docs: DataFrame, query: str, query_skills: list[str], vocabulary: list[str], strings: DataFrame, tiers: DataFrame) -> DataFrame:
    """candidate_id, final_score, rank: evidence-grounded signals where the classic ones restate claims."""
    parts = rag_parts(docs, strings, tiers)
    own = signals(docs, query, query_skills, vocabulary).select(F.col("doc_id").alias("candidate_id"), "experience", "education", "projects")
    s = own.join(parts["verdict_signals"], "candidate_id").join(parts["span_signals"], "candidate_id")
    w = S.adaptive(F.lit(query), F.lit(JD_YEARS), F.lit(True), V.WEIGHTS_RAG)
    s = s.withColumn("final_score", S.combined(w, {k: F.col(k) for k in V.WEIGHTS_RAG}))
    return ranking.ranked(s, "final_score", "candidate_id").select("candidate_id", "final_score", "rank")


def signals_sql(tok, bow, words_sql, degree_sql, degrees, projects, split_sql) -> str:
    """The same signals as DuckDB tables, the last one named sig; needs a table p(doc_id, text)."""
    from .profiles import JD, JD_SKILLS, SKILLS

    norm = [V.SYNONYMS.get(s.lower(), s.lower()) for s in JD_SKILLS]
    jd_words = sql_list(JD.split())
    r = f"(CASE WHEN yrs / {JD_YEARS} < 1 THEN yrs / {JD_YEARS} ELSE 1 + least(yrs / {JD_YEARS} - 1, 0.2) * 0.5 END)"
    return f"""jd0 AS (SELECT 0 AS q, {lit(JD)} AS text), {bow('jdv', 'jd0', 'q')},
o1 AS (SELECT doc_id, text, {words_sql('lower(text)', SKILLS)} AS own, list_transform({degrees}, lambda d: {degree_sql('d')}) AS dg, coalesce(list_max(list_transform(regexp_extract_all(lower(text), '(\\d+)\\+?\\s*(?:years?|yrs?)(?:\\s+of)?\\s+experience', 1), lambda x: x::INT)), 0)::DOUBLE AS y FROM p),
rq0 AS (SELECT unnest({sql_list(norm)}) AS skill, generate_subscripts({sql_list(norm)}, 1) - 1 AS idx), ow0 AS (SELECT doc_id, unnest(own) AS skill FROM o1),
na0 AS (SELECT skill, skill AS text FROM rq0), nb0 AS (SELECT DISTINCT skill, skill AS text FROM ow0), {bow('nav', 'na0', 'skill')}, {bow('nbv', 'nb0', 'skill')},
sm0 AS (SELECT nav.skill AS a, nbv.skill AS b, sum(nav.v * nbv.v) AS sim FROM nav JOIN nbv USING (dim) GROUP BY ALL),
bs0 AS (SELECT doc_id, rq0.skill, idx, max(sim) AS best, bool_or(ow0.skill = rq0.skill) AS exact FROM rq0 JOIN sm0 ON sm0.a = rq0.skill JOIN ow0 ON ow0.skill = sm0.b GROUP BY ALL),
cv0 AS (SELECT o1.doc_id, sum(CASE WHEN coalesce(exact, false) THEN 1 ELSE least(greatest((coalesce(best, 0) - {V.SKILL_FLOOR}) / (1 - {V.SKILL_FLOOR}), 0), 1) END) / {len(norm)}.0::DOUBLE AS rs, list(rq0.skill ORDER BY rq0.idx) FILTER (coalesce(exact, false) OR coalesce(best, 0) > {V.SKILL_ACCEPT}) AS matched FROM o1 CROSS JOIN rq0 LEFT JOIN bs0 ON bs0.doc_id = o1.doc_id AND bs0.idx = rq0.idx GROUP BY 1),
{bow('pv0', 'p', 'doc_id')}, se0 AS (SELECT doc_id, sum(pv0.v * jdv.v) AS sem FROM pv0 JOIN jdv USING (dim) GROUP BY 1),
pl0 AS (SELECT doc_id, {split_sql(projects, chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n|•|-|' + chr(92) + 'd+' + chr(92) + '.', 40)} AS ps FROM p),
pj0 AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM pl0), {bow('pjv', 'pj0', 'doc_id, i')},
ps0 AS (SELECT pj0.doc_id, pj0.i, text, coalesce(s, 0) AS sim, row_number() OVER (PARTITION BY pj0.doc_id ORDER BY coalesce(s, 0) DESC, pj0.i) AS place FROM pj0 LEFT JOIN (SELECT doc_id, i, sum(pjv.v * jdv.v) AS s FROM pjv JOIN jdv USING (dim) GROUP BY 1, 2) x ON x.doc_id = pj0.doc_id AND x.i = pj0.i),
pr0 AS (SELECT doc_id, max(sim) AS best, 0.5 * max(sim) + 0.3 * avg(sim) FILTER (place <= 3) + 0.2 * avg(CASE WHEN sim > {V.PROJECT_RELEVANT} THEN 1 ELSE 0 END) AS pr, count(*) AS np, avg(CASE WHEN len(list_filter({jd_words}, lambda w: contains(text, w))) > 0 THEN 1 ELSE 0 END) AS ov FROM ps0 GROUP BY 1),
s1 AS (SELECT o1.*, rs, coalesce(matched, []) AS matched, coalesce(sem, 0) AS sem, coalesce(best, 0) AS pbest, coalesce(pr, 0) AS pr, coalesce(np, 0) AS np, coalesce(ov, 0) AS ov, CASE WHEN y > 10 THEN 5.0 ELSE y END::DOUBLE AS yrs,
  1 / (1 + exp(-(16.0 * len(list_intersect(list_distinct({tok(f'substr({lit(JD)}, 1, {PAIR_CHARS})')}), list_distinct({tok(f'substr(text, 1, {PAIR_CHARS})')}))) / (len(list_distinct({tok(f'substr({lit(JD)}, 1, {PAIR_CHARS})')})) + len(list_distinct({tok(f'substr(text, 1, {PAIR_CHARS})')}))) - 2) / 1.5)) AS ce
  FROM o1 LEFT JOIN cv0 USING (doc_id) LEFT JOIN se0 USING (doc_id) LEFT JOIN pr0 USING (doc_id)),
sig AS (SELECT doc_id, rs AS required_skills, sem AS semantic, ce, CASE WHEN sem > {V.GATE_SEMANTIC} OR rs > {V.GATE_SKILLS} THEN ce ELSE sem * {V.GATE_FACTOR} END AS reranker, round(least({r}, 1), 3) AS experience,
  CASE WHEN list_contains(dg, 'bachelor') OR len(list_filter(dg, lambda d: contains('bachelor', d) OR contains(d, 'bachelor'))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS education, pr AS projects, pbest AS project_best, ov AS project_overlap, np AS n_projects,
  CASE WHEN len(matched) = 0 THEN 0 ELSE len(list_filter(matched, lambda m: contains(lower(text), m))) / len(matched)::DOUBLE END AS evidence, len(list_filter({sql_list(JD_PREFERRED)}, lambda k: list_contains(own, k))) / {len(JD_PREFERRED)}.0::DOUBLE AS preferred_skills FROM s1)"""
