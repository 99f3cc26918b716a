"""Queries over search, evidence, scoring plans, stores and metrics, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions import vectors as Vec
from ..functions import vocab as V
from ..operators import coverage, evaluate, evidence, ranking, search, sections, store
from . import rank
from .profiles import JD, JD_SKILLS, PROFILES_SQL, SKILLS, profiles
from .registry import lit, query, sql_list, table
from .text_queries import DEGREES_SQL, PROJECTS_SQL, W, degree_sql, joined, joined_sql, requirements, split_sql, squash_sql, words_sql

C = F.col
REQS = [(0, 0, "python sql data pipelines"), (0, 1, "python programming"), (1, 0, "machine learning"), (1, 1, "deep learning"), (2, 0, "docker kubernetes"), (3, 0, "statistics thesis")]
TIERS = [(0, "required"), (1, "required"), (2, "preferred"), (3, "preferred")]
REQS_SQL = "reqs(query_id, pos, text) AS (VALUES " + ", ".join(f"({a}, {b}, {lit(t)})" for a, b, t in REQS) + "), tiers(query_id, tier) AS (VALUES " + ", ".join(f"({a}, {lit(t)})" for a, t in TIERS) + ")"


def req_strings(spark):
    return spark.createDataFrame(REQS, "query_id int, pos int, text string")


def req_tiers(spark):
    return spark.createDataFrame(TIERS, "query_id int, tier string")


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[{W}]+')"


def dim(x: str) -> str:
    words = [f"('0x' || md5({x})[{1 + 8 * i}:{8 + 8 * i}])::BIGINT" for i in range(4)]
    return f"((({words[0]} * 256 + {words[1]}) % 768 * 256 + {words[2]}) % 768 * 256 + {words[3]}) % 768"


def bow(name: str, src: str, ids: str) -> str:
    return f"{name} AS (SELECT {ids}, dim, n / sqrt(sum(n * n) OVER (PARTITION BY {ids})) AS v FROM (SELECT {ids}, {dim('tok')} AS dim, sum(c)::DOUBLE AS n FROM (SELECT {ids}, tok, count(*) AS c FROM (SELECT {ids}, unnest({tok('text')}) AS tok FROM {src}) GROUP BY ALL) GROUP BY ALL))"


def header_sql() -> str:
    n = f"trim(translate({squash_sql('lower(line)')}, '•‣◦', '   '))"
    cases = " ".join(rf"WHEN regexp_matches(n, '(^|[^{W}]){w}($|[^{W}])') THEN {lit(v)}" for w, v in V.SECTION_HEADERS)
    return f"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM p),
hd AS (SELECT doc_id, pos, line, CASE WHEN len(string_split(n, ' ')) <= 6 AND regexp_matches(n, '[a-z]') AND NOT regexp_matches(trim(line), '^[•‣◦]') THEN CASE {cases} END END AS label FROM (SELECT *, {n} AS n FROM ln)),
sec AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'other') AS section FROM hd),
ch AS (SELECT doc_id AS candidate_id, doc_id || ':' || pos AS chunk_id, section, line AS text FROM sec WHERE label IS NULL AND trim(line) <> '')"""


CHUNKS_SQL = f"{PROFILES_SQL}, {header_sql()}"


def hybrid_sql() -> str:
    return f"""{bow('cv', 'ch', 'candidate_id, chunk_id')}, {bow('qv', 'reqs', 'query_id, pos')},
sims AS (SELECT query_id, pos, candidate_id, chunk_id, sum(cv.v * qv.v) AS sim FROM cv JOIN qv USING (dim) GROUP BY ALL),
dense AS (SELECT * FROM (SELECT query_id, pos, candidate_id, chunk_id, row_number() OVER (PARTITION BY query_id, pos, candidate_id ORDER BY round(sim, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= 8),
tf AS (SELECT candidate_id, chunk_id, tok, count(*)::DOUBLE AS n FROM (SELECT candidate_id, chunk_id, unnest({tok('text')}) AS tok FROM ch) GROUP BY ALL),
sz AS (SELECT candidate_id, count(*) AS docs, avg(len({tok('text')})) AS avg_len FROM ch GROUP BY 1),
dfr AS (SELECT candidate_id, tok, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT candidate_id, tok, count(*) AS df FROM tf GROUP BY ALL) JOIN sz USING (candidate_id)),
mn AS (SELECT candidate_id, avg(raw) AS mean FROM dfr GROUP BY 1),
qt AS (SELECT query_id, pos, tok, count(*) AS qn FROM (SELECT query_id, pos, unnest({tok('text')}) AS tok FROM reqs) GROUP BY ALL),
bm AS (SELECT query_id, pos, candidate_id, chunk_id, sum(qn * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM tf JOIN qt USING (tok) JOIN dfr USING (candidate_id, tok) JOIN mn USING (candidate_id) JOIN sz USING (candidate_id) JOIN (SELECT candidate_id, chunk_id, len({tok('text')}) AS len FROM ch) USING (candidate_id, chunk_id) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT query_id, pos, candidate_id, chunk_id, row_number() OVER (PARTITION BY query_id, pos, candidate_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 8),
fs AS (SELECT query_id, candidate_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS fs, arg_min(rank, pos) FILTER (l = 'd') AS dense_rank, arg_min(rank, pos) FILTER (l = 'x') AS lexical_rank FROM (SELECT *, 'd' AS l FROM dense UNION ALL SELECT *, 'x' AS l FROM lex) GROUP BY ALL),
hy AS (SELECT * FROM (SELECT query_id, candidate_id, chunk_id, section, text, dense_rank, lexical_rank, fs * CASE WHEN section = 'skills' THEN 0.5 ELSE 1 END AS fused_score, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY round(fs * CASE WHEN section = 'skills' THEN 0.5 ELSE 1 END, 9) DESC, chunk_id) AS rank FROM fs JOIN ch USING (candidate_id, chunk_id)) WHERE rank <= 8),
{bow('dummy', 'reqs', 'query_id')},
f1 AS (SELECT hy.*, len(list_distinct({tok('r.text')})) AS na, len(list_distinct({tok('hy.text')})) AS nb, len(list_intersect(list_distinct({tok('r.text')}), list_distinct({tok('hy.text')}))) AS nab FROM hy JOIN reqs r ON r.query_id = hy.query_id AND r.pos = 0),
ce AS (SELECT *, 1 / (1 + exp(-(8.0 * 2 * nab / (na + nb) - 2) / 1.5)) AS ce_score FROM f1),
sp AS (SELECT * FROM (SELECT query_id, candidate_id, chunk_id, section, text, dense_rank, lexical_rank, fused_score, ce_score, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY round(ce_score, 9) DESC, chunk_id) AS rank FROM ce) WHERE rank <= 3 AND ce_score >= 0.5)"""


HYBRID_SQL = f"WITH {CHUNKS_SQL}, {REQS_SQL}, {hybrid_sql().replace(bow('dummy', 'reqs', 'query_id') + ',' + chr(10), '')} "


def chunks(spark, sf_dir):
    # dealt by document: one shuffle of the texts serves every use of the chunks, the sections and what is grouped by candidate
    return sections.line_chunks(profiles(spark, sf_dir).select("doc_id", "text").repartition("doc_id"))


def spans(spark, sf_dir):
    return rank.evidence_spans(chunks(spark, sf_dir), req_strings(spark))


@query("sections", f"WITH {CHUNKS_SQL} SELECT doc_id, pos, section FROM sec")
def sections_query(spark, sf_dir):
    return sections.sectioned(sections.lines(profiles(spark, sf_dir))).select("doc_id", "pos", "section")


@query("section_headers", f"WITH {CHUNKS_SQL} SELECT doc_id, pos, label FROM hd WHERE label IS NOT NULL")
def section_headers(spark, sf_dir):
    return sections.lines(profiles(spark, sf_dir)).select("doc_id", "pos", X.header_label(C("line")).alias("label")).where("label is not null")


@query("bullets", rf"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^\s*(?:[-*▪○•‣◦]|[0-9]{{1,2}}[.)]|\([0-9]{{1,2}}\))(?:\s|$)')) AS bullets FROM ln GROUP BY 1")
def bullets(spark, sf_dir):
    return sections.lines(profiles(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.is_bullet(C("line"))).alias("bullets"))


_SENT = r"list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: trim(s) <> '')"


@query("chunk_sentences", f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), w AS (SELECT doc_id, s, unnest(range(1, len(s) + 1, 2)) AS i FROM s) SELECT doc_id, count(*) AS n, md5(string_agg(array_to_string(s[i:i + 2], ' '), '|' ORDER BY i)) AS digest FROM w GROUP BY 1")
def chunk_sentences(spark, sf_dir):
    w = sections.sentence_windows(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("digest"))


@query("chunk_merge")
def chunk_merge(spark, sf_dir):
    """Sentence windows merged to at most 120 tokens; a fold, so rows only."""
    pieces = sections.merged_pieces(sections.sentences(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("ordinal", "text"))


@query("chunks")
def chunks_query(spark, sf_dir):
    """The full chunker: words to offsets, sections, ranges and chunk rows."""
    from ..operators.chunking import chunk_documents

    return chunk_documents(profiles(spark, sf_dir).select("doc_id", "text"))


@query("chunk_bullets")
def chunk_bullets(spark, sf_dir):
    from ..operators.chunking import chunk_documents

    return chunk_documents(profiles(spark, sf_dir).select("doc_id", "text")).where("section_type <> 'other'").groupBy("section_type").agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("tokens"))


@query("chunk_layout")
def chunk_layout(spark, sf_dir):
    """Lines and columns of words that have places on a page."""
    from ..operators.chunking import page_lines

    return page_lines(page_words(spark, sf_dir))


def page_words(spark, sf_dir):
    """Invented word places: the words of each page's text in one or two columns."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(squash_of("text"), " ")).alias("at", "text"))
    w = w.select("doc_id", F.floor(C("at") / 60).cast("int").alias("page"), (C("at") % 60).alias("i"), "text")
    x0 = F.when((C("doc_id") % 2 == 0) & (C("i") % 2 == 1), 320.0).otherwise(20.0) + C("i") % 5 * 12.0
    return w.select("doc_id", "page", "i", "text", x0.alias("x0"), (F.floor(C("i") / 6) * 14.0).alias("doctop"), F.lit(10.0).alias("height"))


def squash_of(c):
    return X.squash(F.coalesce(c, F.lit("")))


_SQ = squash_sql("coalesce(text, '')")
_PAGE = f"w AS (SELECT doc_id, generate_subscripts(string_split({_SQ}, ' '), 1) - 1 AS pos FROM documents), x AS (SELECT doc_id, (pos // 60)::INT AS page, CASE WHEN doc_id % 2 = 0 AND pos % 60 % 2 = 1 THEN 320.0 ELSE 20.0 END + pos % 60 % 5 * 12.0 AS x0 FROM w)"


@query("chunk_columns", f"WITH {_PAGE}, g AS (SELECT doc_id, page, x0, lead(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) AS nx FROM x), b AS (SELECT doc_id, page, arg_max(x0, (nx - x0) * 1000 - x0) AS a, arg_max(nx, (nx - x0) * 1000 - x0) AS b FROM g WHERE nx IS NOT NULL GROUP BY 1, 2) SELECT x.doc_id, x.page, CASE WHEN min(b - a) >= 100 AND count(*) FILTER (x0 < a) >= 15 AND count(*) FILTER (x0 > b) >= 15 THEN min((a + b) / 2)::DOUBLE END AS split FROM x LEFT JOIN b USING (doc_id, page) GROUP BY 1, 2")
def chunk_columns(spark, sf_dir):
    return sections.column_split(page_words(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "split")


@query("chunk_coverage", f"WITH {CHUNKS_SQL} SELECT p.doc_id, count(c.line) AS chunk_count, round(coalesce(sum(length(c.line)), 0) / length(any_value(p.text))::DOUBLE, 6) AS coverage, coalesce(sum(length(c.line)), 0) / length(any_value(p.text))::DOUBLE < 0.95 AS warned FROM p LEFT JOIN sec c ON c.doc_id = p.doc_id AND c.label IS NULL AND trim(c.line) <> '' GROUP BY 1")
def chunk_coverage(spark, sf_dir):
    docs = profiles(spark, sf_dir).select("doc_id", "text")
    c = sections.sectioned(sections.lines(docs)).where("label is null and trim(line) <> ''").select("doc_id", F.lit(0).alias("char_start"), F.length("line").alias("char_end"))
    return sections.coverage(c, docs, "doc_id").withColumn("coverage", F.round("coverage", 6))


# --- vectors and search ---
@query("bow_embed", f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {bow('v', 'd', 'doc_id')} SELECT doc_id, dim::INT AS dim, round(v, 9) AS v FROM v")
def bow_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return Vec.bag_of_words(docs, ["doc_id"]).withColumn("v", F.round("v", 9))


_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


@query("dense_topk", f"SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 9) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 8")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q"))
    return search.dense_topk(e.select(C("vec_id").alias("id"), C("embedding").alias("vector")), q, 8).withColumn("score", F.round("score", 6))


@query("filter_payload", "SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 3, 5) AND vec_id % 2 = 0")
def filter_payload(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("even", C("vec_id") % 2 == 0)
    return e.where(store.matches({"label": [1, 3, 5], "even": True})).select(C("vec_id").alias("id"), "label")


_LEX = f"WITH d AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark), "


def doc_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(C("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def item_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(C("item_id").alias("query_id"), "text")


_BM25 = _LEX + f"""tf AS (SELECT chunk_id, tok, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest({tok('text')}) AS tok FROM d) GROUP BY ALL),
sz AS (SELECT count(*) AS docs, avg(len({tok('text')})) AS avg_len FROM d),
dfr AS (SELECT tok, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT tok, count(*) AS df FROM tf GROUP BY 1), sz), mn AS (SELECT avg(raw) AS mean FROM dfr),
qt AS (SELECT query_id, tok, count(*) AS qn FROM (SELECT query_id, unnest({tok('text')}) AS tok FROM q) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(qn * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM tf JOIN qt USING (tok) JOIN dfr USING (tok) JOIN (SELECT chunk_id, len({tok('text')}) AS len FROM d) USING (chunk_id), mn, sz GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 8"""


@query("bm25_topk", _BM25)
def bm25_topk(spark, sf_dir):
    return search.top(search.bm25(doc_chunks(spark, sf_dir), item_queries(spark, sf_dir), []), ["query_id"], "score", "chunk_id", 8).withColumn("score", F.round("score", 6))


@query("rank_lexical", _BM25.replace("FROM benchmark", "FROM benchmark WHERE item_id = 0").replace("rank <= 8", "rank <= 100"))
def rank_lexical(spark, sf_dir):
    """The first hundred documents for one query text."""
    q = item_queries(spark, sf_dir).where("query_id = 0")
    return search.top(search.bm25(doc_chunks(spark, sf_dir), q, []), ["query_id"], "score", "chunk_id", 100).withColumn("score", F.round("score", 6))


@query("overlap_topk", _LEX + f"a AS (SELECT DISTINCT chunk_id, unnest({tok('text')}) AS tok FROM d), b AS (SELECT DISTINCT query_id, unnest({tok('text')}) AS tok FROM q) SELECT * FROM (SELECT query_id, chunk_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank FROM a JOIN b USING (tok) GROUP BY 1, 2) WHERE rank <= 8")
def overlap_topk(spark, sf_dir):
    return search.overlap_topk(doc_chunks(spark, sf_dir), item_queries(spark, sf_dir), 8)


@query("tfidf_rank", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), q AS (SELECT text FROM benchmark WHERE item_id = 0),
tf AS (SELECT doc_id, tok, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({tok('text')}) AS tok FROM d) WHERE length(tok) > 1 AND tok NOT IN ('the', 'and', 'of') GROUP BY ALL),
qt AS (SELECT tok, count(*) AS qn FROM (SELECT unnest({tok('text')}) AS tok FROM q) WHERE length(tok) > 1 AND tok NOT IN ('the', 'and', 'of') GROUP BY 1),
i AS (SELECT tok, qn, ln((2.0 + (SELECT count(*) FROM d)) / (1.0 + coalesce(df, 0) + CASE WHEN qn IS NULL THEN 0 ELSE 1 END)) + 1 AS idf FROM (SELECT tok, count(*) AS df FROM tf GROUP BY 1) FULL JOIN qt USING (tok)),
s AS (SELECT doc_id, sum(n * idf * coalesce(qn, 0) * idf) / nullif(sqrt(sum((n * idf) ** 2)) * (SELECT sqrt(sum((qn * idf) ** 2)) FROM i WHERE qn IS NOT NULL), 0) AS score FROM tf JOIN i USING (tok) GROUP BY 1)
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)""")
def tfidf_rank(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]  # one query text
    return search.tfidf_rank(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), q, stop=["the", "and", "of"]).withColumn("score", F.round("score", 6))


@query("rrf_fuse", "WITH r AS (SELECT user_id AS query_id, event_type AS list_id, event_id % 40 AS chunk_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT query_id, list_id, chunk_id, min(rank) AS rank FROM r GROUP BY ALL) SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score FROM f GROUP BY ALL")
def rrf_fuse(spark, sf_dir):
    from pyspark.sql.window import Window

    r = table(spark, sf_dir, "events").select(C("user_id").alias("query_id"), C("event_type").alias("list_id"), (C("event_id") % 40).alias("chunk_id"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")).alias("rank"))
    best = r.groupBy("query_id", "list_id", "chunk_id").agg(F.min("rank").alias("rank"))
    return search.rrf(best, ["query_id"], "chunk_id").withColumn("fused_score", F.round("fused_score", 9))


@query("hybrid_retrieve", HYBRID_SQL + "SELECT query_id, candidate_id, chunk_id, section, dense_rank, lexical_rank, round(fused_score, 9) AS fused_score, rank FROM hy")
def hybrid_retrieve(spark, sf_dir):
    return search.hybrid(chunks(spark, sf_dir), req_strings(spark)).select("query_id", "candidate_id", "chunk_id", "section", "dense_rank", "lexical_rank", F.round("fused_score", 9).alias("fused_score"), "rank")


@query("rerank_topn", f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), c AS (SELECT item_id AS chunk_id, text FROM benchmark), f AS (SELECT query_id, chunk_id, len(list_intersect(list_distinct({tok('q.text')}), list_distinct({tok('c.text')}))) AS nab, len(list_distinct({tok('q.text')})) + len(list_distinct({tok('c.text')})) AS n FROM q, c), s AS (SELECT query_id, chunk_id, 1 / (1 + exp(-(16.0 * nab / n - 2) / 1.5)) AS ce FROM f) SELECT query_id, chunk_id, round(ce, 6) AS ce_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ce, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 3")
def rerank_topn(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(C("item_id").alias("chunk_id"), "text").crossJoin(search.small_side(b.select(C("item_id").alias("query_id"), C("text").alias("query"))))
    return search.rerank(pairs, "query", ["query_id"], floor=None).select("query_id", "chunk_id", F.round("ce_score", 6).alias("ce_score"), "rank")


@query("evidence_retrieve", HYBRID_SQL + "SELECT query_id, candidate_id, chunk_id, section, round(fused_score, 9) AS fused_score, round(ce_score, 6) AS ce_score, rank FROM sp")
def evidence_retrieve(spark, sf_dir):
    return spans(spark, sf_dir).select("query_id", "candidate_id", "chunk_id", "section", F.round("fused_score", 9).alias("fused_score"), F.round("ce_score", 6).alias("ce_score"), "rank")


@query("rerank_floor", HYBRID_SQL + "SELECT query_id, candidate_id, count(*) AS n, round(max(ce_score), 6) AS best FROM sp GROUP BY 1, 2")
def rerank_floor(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("query_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ce_score"), 6).alias("best"))


VERDICTS_SQL = "vd AS (SELECT c.doc_id AS candidate_id, t.query_id, t.tier, best, CASE WHEN coalesce(best, 0) > 0.6 THEN 'demonstrated' WHEN coalesce(best, 0) > 0.3 THEN 'claimed_only' ELSE 'absent' END AS verdict, bc FROM p c CROSS JOIN tiers t LEFT JOIN (SELECT query_id, candidate_id, max(ce_score) AS best, arg_max(chunk_id, (ce_score, chunk_id)) AS bc FROM sp GROUP BY 1, 2) b ON b.query_id = t.query_id AND b.candidate_id = c.doc_id)"
_VSQL = HYBRID_SQL.rstrip() + ", " + VERDICTS_SQL + " "


@query("verify_evidence", _VSQL + "SELECT query_id, candidate_id, verdict, CASE WHEN best IS NOT NULL AND verdict <> 'absent' THEN bc ELSE '' END AS cited FROM vd")
def verify_evidence(spark, sf_dir):
    v = evidence.deterministic_verdicts(spans(spark, sf_dir), req_tiers(spark), rank.candidates(profiles(spark, sf_dir)))
    return v.select("query_id", "candidate_id", "verdict", joined("cited_chunk_ids").alias("cited"))


@query("verdict_aggregate", _VSQL + "SELECT candidate_id, round(sum(w * CASE verdict WHEN 'demonstrated' THEN 1.0 WHEN 'claimed_only' THEN 0.35 ELSE 0 END) / sum(w), 6) AS evidence, round(sum(CASE WHEN verdict <> 'absent' THEN w ELSE 0 END) / sum(w), 6) AS required_skills FROM (SELECT *, CASE WHEN tier = 'required' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END AS w FROM vd) GROUP BY 1")
def verdict_aggregate(spark, sf_dir):
    got = rank.rag_parts(profiles(spark, sf_dir), req_strings(spark), req_tiers(spark))
    return got["verdict_signals"].select("candidate_id", F.round("evidence", 6).alias("evidence"), F.round("required_skills", 6).alias("required_skills"))


@query("rag_signals", HYBRID_SQL + "SELECT doc_id AS candidate_id, round(coalesce(sum(sem), 0) / 4, 6) AS semantic, round(coalesce(sum(ce), 0) / 4, 6) AS reranker FROM p LEFT JOIN (SELECT query_id, candidate_id, avg(fused_score) * 8 AS sem, avg(ce_score) AS ce FROM sp GROUP BY 1, 2) s ON s.candidate_id = p.doc_id GROUP BY 1")
def rag_signals(spark, sf_dir):
    got = rank.rag_parts(profiles(spark, sf_dir), req_strings(spark), req_tiers(spark))
    return got["span_signals"].select("candidate_id", F.round("semantic", 6).alias("semantic"), F.round("reranker", 6).alias("reranker"))


@query("evidence_detail", _VSQL + "SELECT sp.candidate_id, sp.query_id, sp.rank, sp.chunk_id, vd.verdict FROM sp JOIN vd USING (query_id, candidate_id) WHERE sp.query_id = 0")
def evidence_detail(spark, sf_dir):
    s, p = spans(spark, sf_dir), profiles(spark, sf_dir)
    return rank.evidence_detail(s, evidence.deterministic_verdicts(s, req_tiers(spark), rank.candidates(p)), 0).select("candidate_id", "query_id", "rank", "chunk_id", "verdict")


@query("prompt_build", HYBRID_SQL + f""", a AS (SELECT query_id, candidate_id, string_agg('  [' || chunk_id || '] ' || CASE WHEN length({squash_sql('text')}) > 600 THEN substr({squash_sql('text')}, 1, 600) || '...' ELSE {squash_sql('text')} END, chr(10) ORDER BY rank, chunk_id) AS body FROM sp GROUP BY 1, 2)
SELECT candidate_id, md5(string_agg('- ' || query_id || ':' || chr(10) || body, chr(10) ORDER BY query_id)) AS digest FROM a GROUP BY 1""")
def prompt_build(spark, sf_dir):
    got = evidence.evidence_prompts(spans(spark, sf_dir), ["query_id"])
    body = F.regexp_extract("prompt", r"(?s)Candidate: [^\n]*\n(.*)\nAnswer with a JSON", 1)
    return got.select("candidate_id", F.md5(body).alias("digest"))


_CIT = "WITH pr AS (SELECT event_id, event_id % 5 AS cited, CASE event_type WHEN 'click' THEN 'absent' ELSE 'demonstrated' END AS verdict, CASE event_id % 4 WHEN 0 THEN 'Text  NUMBER ' || (event_id % 5) WHEN 1 THEN 'paraphrase' END AS quote FROM events), b AS (SELECT *, cited > 2 OR (coalesce(quote, '') <> '' AND NOT (quote LIKE 'Text%' AND cited <= 2)) AS bad FROM pr)"


@query("citation_validate", _CIT + " SELECT event_id, CASE WHEN bad THEN 'claimed_only' ELSE verdict END AS verdict, CASE WHEN bad THEN NULL ELSE quote END AS quote, bad AS rejected FROM b")
def citation_validate(spark, sf_dir):
    """Invented proposals: chunks 0 to 2 are spans, 3 and 4 are not; quotes are exact but for case and spaces, or paraphrased."""
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", F.lit(1).alias("candidate_id"), F.when(C("event_type") == "click", "absent").otherwise("demonstrated").alias("verdict"), F.array((C("event_id") % 5).cast("string")).alias("cited_chunk_ids"), F.when(C("event_id") % 4 == 0, F.concat(F.lit("Text  NUMBER "), (C("event_id") % 5).cast("string"))).when(C("event_id") % 4 == 1, "paraphrase").alias("quote"))
    s = spark.range(3).select(F.lit(1).alias("candidate_id"), C("id").cast("string").alias("chunk_id"), F.concat(F.lit("A text number "), C("id").cast("string"), F.lit(" here")).alias("text"))
    return evidence.validate_citations(p, s, ["event_id"]).select("event_id", "verdict", "quote", "rejected")


RAW = ['```json\n[{"skill_name": "a", "verdict": "absent", "cited_chunk_ids": [], "quote": null}]\n```', '{"note": [], "result": [{"skill_name": "b", "verdict": "demonstrated", "cited_chunk_ids": ["x:1"], "quote": "q"}]}', '[{"skill_name": "c", "verdict": "claimed_only"}]', "not json", '{"result": []}']


@query("json_unwrap", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '' END AS skills FROM events")
def json_unwrap(spark, sf_dir):
    raw = F.get(X.strings(RAW), (C("event_id") % 5).cast("int"))
    v = F.coalesce(F.transform(evidence.unwrapped(raw), lambda x: x["skill_name"]), F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(v, "|").alias("skills"))


# --- skills by similarity ---
_NAMES = ["python", "sql database", "docker", "machine learning", "java", "spring boot", "react", "linux admin", "aws cloud", "kafka streams"]
_REQ = ["python", "sql", "deep learning", "cloud services", "kafka streams", "rust"]
_OWN = f"own AS (SELECT doc_id, unnest(list_filter({sql_list(_NAMES)}, lambda s, i: (doc_id + i) % 3 = 0)) AS skill FROM documents), rq AS (SELECT doc_id, unnest({sql_list(_REQ)}) AS skill, generate_subscripts({sql_list(_REQ)}, 1) - 1 AS idx FROM documents), a AS (SELECT DISTINCT skill, skill AS text FROM rq), b AS (SELECT DISTINCT skill, skill AS text FROM own), {bow('av', 'a', 'skill')}, {bow('bv', 'b', 'skill')}, sm AS (SELECT av.skill AS a, bv.skill AS b, sum(av.v * bv.v) AS sim FROM av JOIN bv USING (dim) GROUP BY ALL), sc AS (SELECT rq.doc_id, idx, rq.skill, coalesce(max(sim), 0) AS best, coalesce(bool_or(own.skill = rq.skill), false) AS exact FROM rq LEFT JOIN (own JOIN sm ON sm.b = own.skill) ON own.doc_id = rq.doc_id AND sm.a = rq.skill GROUP BY ALL)"


def scored_skills(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    own = d.select("doc_id", F.explode(F.filter(X.strings(_NAMES), lambda s, i: (C("doc_id") + i + 1) % 3 == 0)).alias("skill"))
    return coverage.best_similarity(d.select("doc_id", F.posexplode(X.strings(_REQ)).alias("idx", "skill")), own, ["doc_id"])


def _coverage(name, floor, accept, op, weight, **how):
    w = f"CASE WHEN idx < {weight} THEN 2.0 ELSE 1.0 END" if weight else "1.0"

    @query(name, f"WITH {_OWN} SELECT doc_id, round((sum({w} * CASE WHEN exact THEN 1 ELSE least(greatest((best - {floor}) / (1 - {floor}), 0), 1) END) / sum({w}))::DOUBLE, 6) AS score, coalesce(string_agg(skill, '|' ORDER BY idx) FILTER (exact OR best {op} {accept}), '') AS matched, coalesce(string_agg(skill, '|' ORDER BY idx) FILTER (NOT (exact OR best {op} {accept})), '') AS missing FROM sc GROUP BY 1")
    def run(spark, sf_dir):
        return coverage.semantic_coverage(scored_skills(spark, sf_dir), ["doc_id"], floor, accept, **how).select("doc_id", F.round("score", 6).alias("score"), joined("matched").alias("matched"), joined("missing").alias("missing"))


_coverage("skill_coverage_sem", V.SKILL_FLOOR, V.SKILL_ACCEPT, ">", 3, heavy=3)
_coverage("skill_coverage_nb4", V.SKILL_FLOOR_EIGHT, V.SKILL_ACCEPT_EIGHT, ">=", None, heavy=None, inclusive=True)


@query("skill_semantic", f"WITH {_OWN} SELECT doc_id, round(avg(best), 6) AS score FROM sc GROUP BY 1")
def skill_semantic(spark, sf_dir):
    return scored_skills(spark, sf_dir).groupBy("doc_id").agg(F.round(F.avg("best"), 6).alias("score"))


@query("skill_score_v2", f"WITH {_OWN} SELECT doc_id, round(0.6 * avg(CASE WHEN exact THEN 1 ELSE 0 END) + 0.4 * avg(best), 6) AS score FROM sc GROUP BY 1")
def skill_score_v2(spark, sf_dir):
    return scored_skills(spark, sf_dir).groupBy("doc_id").agg(F.round(0.6 * F.avg(C("exact").cast("int")) + 0.4 * F.avg("best"), 6).alias("score"))


@query("gap_semantic", f"WITH {_OWN} SELECT doc_id, coalesce(string_agg(skill, '|' ORDER BY idx) FILTER (best >= 0.6), '') AS matched, coalesce(string_agg(skill, '|' ORDER BY idx) FILTER (best < 0.6), '') AS missing FROM sc GROUP BY 1")
def gap_semantic(spark, sf_dir):
    def names(cond):
        return joined(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("idx", "skill")))), lambda x: x["skill"]))

    return scored_skills(spark, sf_dir).groupBy("doc_id").agg(names(C("best") >= V.GAP_ACCEPT).alias("matched"), names(C("best") < V.GAP_ACCEPT).alias("missing"))


CONCEPTS = [("python programming", "python; scripting", "c:1"), ("machine learning", "ml|deep learning", "c:2"), ("relational database", "sql", "c:3"), ("", "x", "c:4"), ("container platform", "docker; kubernetes", "c:5")]
_CON = "cr(label, alts, uri) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in CONCEPTS) + "), con AS (SELECT trim(label) AS label, list_filter(list_transform(string_split(replace(alts, '|', ';'), ';'), lambda a: trim(a)), lambda a: a <> '') AS alts, uri FROM cr WHERE trim(label) <> '')"


def concept_table(spark):
    from ..sources.files import concept_rows

    return concept_rows(spark.createDataFrame(CONCEPTS, "preferredLabel string, alt_labels string, conceptUri string"))


@query("concepts_load", f"WITH {_CON} SELECT label AS preferred_label, {joined_sql('alts')} AS alt_labels, uri AS concept_uri FROM con")
def concepts_load(spark, sf_dir):
    return concept_table(spark).select("preferred_label", joined("alt_labels").alias("alt_labels"), "concept_uri")


@query("index_concepts", f"WITH {_CON}, t AS (SELECT uri AS id, label || ' | ' || array_to_string(alts, ', ') AS text FROM con), {bow('v', 't', 'id')} SELECT id, dim::INT AS dim, round(v, 9) AS v FROM v")
def index_concepts(spark, sf_dir):
    named = concept_table(spark).select(C("concept_uri").alias("id"), F.concat_ws(" | ", "preferred_label", F.array_join("alt_labels", ", ")).alias("text"))
    return Vec.bag_of_words(named, ["id"]).withColumn("v", F.round("v", 9))


_SK = ["Python", "deep learning", "sql", "painting", "docker"]
_LOOK = f"{_CON}, sk AS (SELECT unnest({sql_list(_SK)}) AS skill, generate_subscripts({sql_list(_SK)}, 1) - 1 AS idx), a AS (SELECT skill, skill AS text FROM sk), b AS (SELECT label, label || ' | ' || array_to_string(alts, ', ') AS text FROM con), {bow('av', 'a', 'skill')}, {bow('bv', 'b', 'label')}, bs AS (SELECT skill, arg_max(label, sim) AS label, max(sim) AS sim FROM (SELECT skill, label, sum(av.v * bv.v) AS sim FROM av JOIN bv USING (dim) GROUP BY ALL) GROUP BY 1 HAVING max(sim) >= 0.3), lk AS (SELECT sk.skill, sk.idx, coalesce(bs.label, sk.skill) AS label, bs.sim, con.alts FROM sk LEFT JOIN bs USING (skill) LEFT JOIN con ON con.label = bs.label)"


def looked_up(spark):
    return evidence.concept_lookup(spark.createDataFrame([(s, i) for i, s in enumerate(_SK)], "skill string, idx int"), concept_table(spark))


@query("concept_lookup", f"WITH {_LOOK} SELECT skill, label, coalesce(array_to_string(alts, '|'), '') AS alts, round(sim, 6) AS similarity FROM lk")
def concept_lookup(spark, sf_dir):
    return looked_up(spark).select("skill", "label", joined("alt_labels").alias("alts"), F.round("similarity", 6).alias("similarity"))


_JDR = "must have python programming and sql. nice to have: docker"


@query("requirements_normalized", f"WITH {_LOOK} SELECT skill, CASE WHEN contains(lower({lit(_JDR)}), lower(label)) THEN 'required' ELSE 'preferred' END AS tier, 'keyword_fallback' AS source FROM lk")
def requirements_normalized(spark, sf_dir):
    return evidence.tiered(looked_up(spark), F.lit(_JDR)).select("skill", "tier", "source")


# --- plans ---
_SIG = rank.signals_sql(tok, bow, words_sql, degree_sql, DEGREES_SQL, PROJECTS_SQL, split_sql)


def _plan(name, build, sql):
    @query(name, f"WITH {PROFILES_SQL}, {_SIG} {sql}")
    def run(spark, sf_dir):
        return build(rank.signals(profiles(spark, sf_dir), JD, JD_SKILLS, SKILLS))


def _weighted(w: dict[str, float]) -> str:
    return " + ".join(f"{v} * {k}" for k, v in w.items())


_V1W = {**V.WEIGHTS, "experience": 0.20, "semantic": 0.06}
_plan("rank_v1", lambda s: ranking.ranked(rank.legacy_score(s, JD, 4.0, True), "final_score", "doc_id").select("doc_id", F.round("final_score", 4).alias("final_score"), "rank"), f", f AS (SELECT doc_id, round({_weighted(_V1W)}, 4) AS final_score FROM sig) SELECT doc_id, final_score, row_number() OVER (ORDER BY final_score DESC, doc_id)::INT AS rank FROM f")
_UW = {k: v / 100 for k, v in V.WEIGHTS_CLIENT.items()}
_plan("job_score", lambda s: rank.weighted(s, V.WEIGHTS_CLIENT).select("doc_id", F.round("final_score", 4).alias("final_score")), f"SELECT doc_id, round({_weighted(_UW)}, 4) AS final_score FROM sig")
_RW = {k: v / 2.0 for k, v in {"required_skills": 1, "semantic": 1, "reranker": 0, "experience": 0, "education": 0, "projects": 0, "evidence": 0}.items()}
_plan("rescore", lambda s: rank.weighted(s, {k: v * 100 for k, v in _RW.items()}).select("doc_id", F.round("final_score", 4).alias("final_score"), S.score_band(C("final_score")).alias("band")), f", f AS (SELECT doc_id, round({_weighted(_RW)}, 4) AS final_score FROM sig) SELECT doc_id, final_score, CASE WHEN final_score >= 0.75 THEN 'high' WHEN final_score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM f")
_plan("rank_v2", lambda s: ranking.ranked(rank.five_signals(s), "final_score", "doc_id").select("doc_id", "final_score", "rank"), ", f AS (SELECT doc_id, round(0.10 * required_skills + 0.20 * semantic + 0.10 * project_best + 0.50 * education + 0.10 * experience, 4) AS final_score FROM sig) SELECT doc_id, final_score, row_number() OVER (ORDER BY final_score DESC, doc_id)::INT AS rank FROM f")
_plan("rank_nb4", lambda s: ranking.ranked(rank.eight_signals(s), "final_score", "doc_id").select("doc_id", "final_score", "rank"), ", f AS (SELECT doc_id, round(0.32 * required_skills + 0.08 * preferred_skills + 0.16 * semantic + 0.16 * reranker + 0.10 * experience + 0.06 * education + 0.07 * project_best + 0.05 * evidence, 4) AS final_score FROM sig) SELECT doc_id, final_score, row_number() OVER (ORDER BY final_score DESC, doc_id)::INT AS rank FROM f")
_plan("project_score", lambda s: s.select("doc_id", F.round("projects", 6).alias("score")), "SELECT doc_id, round(projects, 6) AS score FROM sig")
_plan("project_score_best", lambda s: s.select("doc_id", F.round("project_best", 6).alias("score")), "SELECT doc_id, round(project_best, 6) AS score FROM sig")
_plan("project_score_v2", lambda s: s.select("doc_id", F.round(F.when(C("n_projects") > 0, C("projects") + 0.1 * C("project_overlap")).otherwise(0.0), 6).alias("score")), "SELECT doc_id, round(CASE WHEN n_projects > 0 THEN projects + 0.1 * project_overlap ELSE 0 END, 6) AS score FROM sig")
_plan("semantic_sim", lambda s: s.select("doc_id", F.round("semantic", 6).alias("score")), "SELECT doc_id, round(semantic, 6) AS score FROM sig")
_plan("rerank_doc", lambda s: s.select("doc_id", F.round("ce", 6).alias("score")), "SELECT doc_id, round(ce, 6) AS score FROM sig")
_plan("index_candidates", lambda s: s.select("doc_id", "n_projects", F.round("evidence", 6).alias("evidence")), "SELECT doc_id, n_projects, round(evidence, 6) AS evidence FROM sig")


@query("semantic_sim_enriched", f"WITH {PROFILES_SQL}, t AS (SELECT doc_id, text || ' ' || array_to_string({words_sql('lower(text)', SKILLS)}, ' ') AS text FROM p), j AS (SELECT {lit(JD)} AS text, 0 AS k), {bow('tv', 't', 'doc_id')}, {bow('jv', 'j', 'k')} SELECT t.doc_id, round(coalesce(s, 0), 6) AS score FROM t LEFT JOIN (SELECT doc_id, sum(tv.v * jv.v) AS s FROM tv JOIN jv USING (dim) GROUP BY 1) USING (doc_id)")
def semantic_sim_enriched(spark, sf_dir):
    p = profiles(spark, sf_dir)
    rich = p.select("doc_id", F.concat_ws(" ", "text", F.array_join(X.found_words(F.lower("text"), SKILLS), " ")).alias("text"))
    return rank.similarity_to(rich, JD).select("doc_id", F.round("semantic", 6).alias("score"))


_RAGW = rank.rag_weights()


@query("rank_rag", _VSQL.rstrip() + f""", {_SIG},
va AS (SELECT candidate_id, sum(w * CASE verdict WHEN 'demonstrated' THEN 1.0 WHEN 'claimed_only' THEN 0.35 ELSE 0 END) / sum(w) AS ev, sum(CASE WHEN verdict <> 'absent' THEN w ELSE 0 END) / sum(w) AS rs FROM (SELECT *, CASE WHEN tier = 'required' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END AS w FROM vd) GROUP BY 1),
ss AS (SELECT doc_id AS candidate_id, coalesce(sum(sem), 0) / 4 AS sem, coalesce(sum(ce), 0) / 4 AS ce FROM p LEFT JOIN (SELECT query_id, candidate_id, avg(fused_score) * 8 AS sem, avg(ce_score) AS ce FROM sp GROUP BY 1, 2) s ON s.candidate_id = p.doc_id GROUP BY 1),
f AS (SELECT sig.doc_id AS candidate_id, round({_RAGW['required_skills']} * rs + {_RAGW['semantic']} * ss.sem + {_RAGW['reranker']} * ss.ce + {_RAGW['experience']} * experience + {_RAGW['education']} * education + {_RAGW['projects']} * projects + {_RAGW['evidence']} * ev, 4) AS final_score FROM sig JOIN va ON va.candidate_id = sig.doc_id JOIN ss ON ss.candidate_id = sig.doc_id)
SELECT candidate_id, final_score, row_number() OVER (ORDER BY final_score DESC, candidate_id)::INT AS rank FROM f""")
def rank_rag(spark, sf_dir):
    """The flagship: hybrid retrieval, reranking, verdicts and signals of every document, ranked."""
    return rank.rank_rag(profiles(spark, sf_dir), JD, JD_SKILLS, SKILLS, req_strings(spark), req_tiers(spark))


# --- stores, jobs, logs ---
@query("index_chunks", f"WITH {CHUNKS_SQL} SELECT candidate_id, chunk_id, section AS section_type, substr(sha256(text), 1, 16) AS content FROM ch")
def index_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("candidate_id", "chunk_id", C("section").alias("section_type"), X.content_id(C("text")).alias("content"))


@query("store_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 100 + vec_id % 2 ELSE label END AS label FROM embeddings")
def store_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector"), C("label").cast("long").alias("label"))
    some = e.where("id % 3 = 0")
    new = some.withColumn("label", F.lit(99).cast("long")).withColumn("seq", F.lit(1)).unionByName(some.withColumn("label", 100 + C("id") % 2).withColumn("seq", F.lit(2)))
    return store.upserted(e, new, 64).select("id", "label")


@query("store_delete", "SELECT vec_id AS id FROM embeddings WHERE label IS NULL OR label <> 4")
def store_delete(spark, sf_dir):
    return store.deleted(table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), "label"), {"label": 4}).select("id")


@query("store_count", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def store_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_CACHE = "c AS (SELECT DISTINCT sha256('verify' || chr(31) || (event_id % 300)) AS key FROM events WHERE event_id % 4 = 0 AND event_id % 8 <> 0), rq AS (SELECT event_id, user_id, sha256('verify' || chr(31) || (event_id % 500)) AS key FROM events)"


def cache_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cache = e.where("event_id % 4 = 0").select(X.cache_key(F.lit("verify"), (C("event_id") % 300).cast("string")).alias("key"), F.when(C("event_id") % 8 != 0, "r").alias("response"))
    return e.select("event_id", "user_id", X.cache_key(F.lit("verify"), (C("event_id") % 500).cast("string")).alias("key")), cache


@query("cache_split", f"WITH {_CACHE} SELECT event_id, key IN (SELECT key FROM c) AS hit FROM rq")
def cache_split(spark, sf_dir):
    hits, misses = store.cache_split(*cache_tables(spark, sf_dir))
    return hits.select("event_id", F.lit(True).alias("hit")).unionByName(misses.select("event_id", F.lit(False).alias("hit")))


@query("llm_budget", f"WITH {_CACHE} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 5 AS blocked FROM rq WHERE key NOT IN (SELECT key FROM c)")
def llm_budget(spark, sf_dir):
    _, misses = store.cache_split(*cache_tables(spark, sf_dir))
    return store.within_budget(misses, "user_id", "event_id", 5).select("event_id", "user_id", "blocked")


@query("llm_usage", "SELECT event_type AS op, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 <> 0) AS calls, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 7 = 0) AS blocked, sum(event_id % 100)::BIGINT AS prompt_tokens, round(sum(value), 4) AS latency_ms FROM events GROUP BY 1")
def llm_usage(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(C("event_type").alias("op"), (C("event_id") % 3 == 0).alias("hit"), (C("event_id") % 7 == 0).alias("blocked"), (C("event_id") % 100).alias("prompt_tokens"), C("value").alias("latency_ms"))
    return store.usage(log).withColumn("latency_ms", F.round("latency_ms", 4))


@query("ingest_dedupe", "SELECT substr(sha256(coalesce(text, '')), 1, 16) AS candidate_id, min(doc_id) AS first, count(*) AS uploads FROM documents GROUP BY 1")
def ingest_dedupe(spark, sf_dir):
    return store.deduped_uploads(table(spark, sf_dir, "documents"), "doc_id")


@query("ingest_status", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def ingest_status(spark, sf_dir):
    s = table(spark, sf_dir, "events").withColumn("status", F.when(C("event_type") == "purchase", "done").otherwise("processing"))
    return store.scorable(s).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# --- metrics ---
_GOLD = "g AS (SELECT doc_id, doc_id % 23 AS r, doc_id % 7 AS c, CASE WHEN quality = 0 THEN 'absent' WHEN toxic = 1 THEN 'claimed_only' ELSE 'demonstrated' END AS v FROM labels), pd AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'demonstrated' WHEN 1 THEN 'claimed_only' ELSE 'absent' END AS verdict FROM labels WHERE doc_id % 5 <> 0)"


def gold(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (C("doc_id") % 23).alias("r"), (C("doc_id") % 7).alias("c"), F.when(C("quality") == 0, "absent").when(C("toxic") == 1, "claimed_only").otherwise("demonstrated").alias("v"))


def predicted(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("doc_id % 5 <> 0").select("doc_id", F.when(C("doc_id") % 4 == 0, "demonstrated").when(C("doc_id") % 4 == 1, "claimed_only").otherwise("absent").alias("verdict"))


@query("eval_accuracy", f"WITH {_GOLD} SELECT coalesce(v, 'all') AS v, count(*) AS n, round(avg(CASE WHEN v2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT v, v = coalesce(verdict, 'absent') AS v2 FROM g LEFT JOIN pd USING (doc_id)) GROUP BY ROLLUP (v)")
def eval_accuracy(spark, sf_dir):
    return evaluate.accuracy(gold(spark, sf_dir), predicted(spark, sf_dir), ["doc_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query("eval_false_missing", f"WITH {_GOLD} SELECT c, count(*) AS demonstrated, count(*) FILTER (coalesce(verdict, 'absent') <> 'demonstrated') AS missed, round(count(*) FILTER (coalesce(verdict, 'absent') <> 'demonstrated') / count(*), 6) AS rate FROM g LEFT JOIN pd USING (doc_id) WHERE v = 'demonstrated' GROUP BY 1")
def eval_false_missing(spark, sf_dir):
    return evaluate.false_missing(gold(spark, sf_dir), predicted(spark, sf_dir), ["doc_id"], "c").withColumn("rate", F.round("rate", 6))


@query("gold_pairs", f"WITH {_GOLD} SELECT r, c, v, count(*) AS n FROM g GROUP BY ALL")
def gold_pairs(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("r", "c", "v").agg(F.count(F.lit(1)).alias("n"))


@query("eval_alias_grid", "WITH al AS (SELECT r, CASE WHEN r % 5 = 0 THEN [NULL::BIGINT] ELSE [r, r + 1] END AS sk FROM range(23) t(r)), vs AS (SELECT doc_id % 24 AS skill, doc_id % 7 AS c, max(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS k FROM labels GROUP BY 1, 2), x AS (SELECT r, unnest(sk) AS skill FROM al) SELECT r, c.c, CASE coalesce(max(k), 0) WHEN 2 THEN 'demonstrated' WHEN 1 THEN 'claimed_only' ELSE 'absent' END AS verdict FROM x CROSS JOIN range(7) c(c) LEFT JOIN vs ON vs.skill = x.skill AND vs.c = c.c GROUP BY 1, 2")
def eval_alias_grid(spark, sf_dir):
    alias = spark.range(23).select(C("id").alias("r"), F.when(C("id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(C("id"), C("id") + 1)).alias("skills"))
    v = table(spark, sf_dir, "labels").select((C("doc_id") % 24).alias("skill"), (C("doc_id") % 7).alias("c"), F.when(C("doc_id") % 4 == 0, "demonstrated").when(C("doc_id") % 4 == 1, "claimed_only").otherwise("absent").alias("verdict"))
    best = v.groupBy("skill", "c").agg(F.max_by("verdict", evaluate.confidence("verdict")).alias("verdict"))
    return evaluate.alias_grid(alias, best, spark.range(7).withColumnRenamed("id", "c"))


@query("eval_citation", "SELECT user_id % 10 AS run, sum(event_id % 4)::BIGINT AS proposed, sum(CASE WHEN event_id % 4 > 2 THEN 1 ELSE 0 END)::BIGINT AS rejected, round((sum(event_id % 4) - sum(CASE WHEN event_id % 4 > 2 THEN 1 ELSE 0 END)) / nullif(sum(event_id % 4), 0)::DOUBLE, 6) AS validity FROM events GROUP BY 1")
def eval_citation(spark, sf_dir):
    r = table(spark, sf_dir, "events").select((C("user_id") % 10).alias("run"), (C("event_id") % 4).alias("proposed"), F.when(C("event_id") % 4 > 2, 1).otherwise(0).cast("long").alias("rejected"))
    return evaluate.citation_validity(r).withColumn("validity", F.round("validity", 6))


@query("eval_kendall", "WITH p AS (SELECT doc_id % 20 AS run, doc_id AS item, doc_id * 7 % 101 AS a, doc_id * 13 % 97 AS b FROM labels) SELECT x.run, round(coalesce((2.0 * count(*) FILTER (y.item IS NOT NULL AND (x.a - y.a) * (x.b - y.b) > 0) - count(y.item)) / nullif(count(y.item), 0), 0), 6)::DOUBLE AS tau FROM p x LEFT JOIN p y ON x.run = y.run AND x.item < y.item GROUP BY 1")
def eval_kendall(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select((C("doc_id") % 20).alias("run"), C("doc_id").alias("item"), (C("doc_id") * 7 % 101).alias("a"), (C("doc_id") * 13 % 97).alias("b"))
    return evaluate.kendall_tau(p, ["run"]).withColumn("tau", F.round("tau", 6))


@query("eval_agreement", "SELECT count(*) AS n, round(avg(CASE WHEN (doc_id % 2 = 0) = (doc_id % 3 = 0) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM labels")
def eval_agreement(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id")

    def t(n):
        return d.withColumn("tier", F.when(C("doc_id") % n == 0, "required").otherwise("preferred"))

    return evaluate.agreement(t(2), t(3), ["doc_id"]).withColumn("agreement", F.round("agreement", 6))


_DEMO, _CLAIM = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9], [0.2, 0.3, 0.45]


@query("eval_sweep", f"WITH {_GOLD}, t AS (SELECT d::DOUBLE AS demo, k::DOUBLE AS claim FROM (SELECT unnest({_DEMO}) AS d), (SELECT unnest({_CLAIM}) AS k) WHERE k < d), s AS (SELECT demo, claim, v, v = CASE WHEN ce > demo THEN 'demonstrated' WHEN ce > claim THEN 'claimed_only' ELSE 'absent' END AS hit FROM (SELECT v, (doc_id * 37 % 101) / 101.0::DOUBLE AS ce FROM g), t), a AS (SELECT demo, claim, avg(hit::INT) AS accuracy, avg(hit::INT) FILTER (v = 'demonstrated') AS recall FROM s GROUP BY 1, 2) SELECT demo, claim, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, row_number() OVER (ORDER BY accuracy DESC, recall DESC, demo, claim)::INT AS place FROM a")
def eval_sweep(spark, sf_dir):
    g = gold(spark, sf_dir)
    ce = g.select("doc_id", (C("doc_id") * 37 % 101 / 101.0).alias("ce"))
    return evaluate.sweep(ce, g, ["doc_id"], _DEMO, _CLAIM).select("demo", "claim", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"), "place")


@query("eval_ranking", f"WITH {_GOLD}, x AS (SELECT c, count(*) FILTER (verdict = 'demonstrated') AS demonstrated, count(*) FILTER (verdict = 'claimed_only') AS claimed FROM g JOIN pd USING (doc_id) GROUP BY 1) SELECT *, row_number() OVER (ORDER BY demonstrated DESC, claimed DESC, c)::INT AS rank FROM x")
def eval_ranking(spark, sf_dir):
    return evaluate.evidence_ranking(gold(spark, sf_dir).join(predicted(spark, sf_dir), "doc_id"))


@query("gold_integrity", f"WITH {_GOLD}, l AS (SELECT r, c, min(v) AS v FROM g GROUP BY 1, 2) SELECT 'unknown_verdict' AS problem, 0::BIGINT AS n UNION ALL SELECT 'double_label', count(*) FROM (SELECT r, c FROM g GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'missing_pair', (SELECT count(*) FROM range(23) a(r), range(7) b(c)) - (SELECT count(*) FROM l) UNION ALL SELECT 'no_quote', count(*) FROM g WHERE v = 'demonstrated' AND doc_id % 9 = 0")
def gold_integrity(spark, sf_dir):
    g = gold(spark, sf_dir).withColumn("quote", F.when(C("doc_id") % 9 != 0, "q"))
    return evaluate.gold_checks(g, spark.range(23).withColumnRenamed("id", "r"), spark.range(7).withColumnRenamed("id", "c"))


_GP = ", gp AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, candidate_id, chunk_id FROM ch WHERE contains(lower(text), '{w}')" for i, w in enumerate(["python", "machine", "docker", "statistics"])) + ") "


@query("eval_recall", HYBRID_SQL.rstrip() + _GP + "SELECT 'hybrid' AS config, h AS hits, n AS pairs, round(h / n::DOUBLE, 6) AS recall FROM (SELECT (SELECT count(*) FROM hy JOIN gp USING (query_id, candidate_id, chunk_id) WHERE rank <= 3) AS h, (SELECT count(*) FROM gp) AS n)")
def eval_recall(spark, sf_dir):
    c = chunks(spark, sf_dir)
    top = search.hybrid(c, req_strings(spark), k=3, texts=False).withColumn("config", F.lit("hybrid"))
    return evaluate.recall_at_k(gold_chunks(c), top, ["query_id", "candidate_id"]).withColumn("recall", F.round("recall", 6))


def gold_chunks(c):
    """Stand-in gold pairs: chunks that name a requirement's first word."""
    words = ["python", "machine", "docker", "statistics"]
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(i)) for i, w in enumerate(words)]))
    return c.select(F.explode(named).alias("query_id"), "candidate_id", "chunk_id")


@query("eval_ablation")
def eval_ablation(spark, sf_dir):
    """Recall at 3 of dense, lexical, fused and reranked retrieval; several plans in one, so rows only."""
    c, q = chunks(spark, sf_dir), req_strings(spark)
    keys = ["query_id", "candidate_id", "chunk_id"]
    # each list counts for itself and for the fused one
    alone = F.when(C("list") == "dense", "dense_only").otherwise("bm25_only")
    found = search.ranked_lists(c, q).select("*", F.explode(F.array(alone, F.lit("hybrid"))).alias("config"))
    tops = search.fuse(found, c, V.DENSE_K, ("config",)).withColumnRenamed("rank", "place")
    first = F.broadcast(q.where("pos = 0").select("query_id", C("text").alias("query")))
    # all configs are reranked, so that what was retrieved is read once; only the fused one's order counts
    scored = search.rerank(tops.join(first, "query_id"), "query", ["config", *keys[:2]], V.DENSE_K, floor=None)
    configs = F.array(F.when(C("place") <= 3, C("config")), F.when((C("config") == "hybrid") & (C("rank") <= V.RERANK_K), "hybrid_ce"))
    top = scored.select(*keys, F.explode(F.array_compact(configs)).alias("config"))
    return evaluate.recall_at_k(gold_chunks(c), top, keys[:2]).withColumn("recall", F.round("recall", 6))


@query("stream_ingest")
def stream_ingest(spark, sf_dir):
    """Documents taken in as a stream of files: one row per content, with its status."""
    from ..streaming.ingest import ingest_available

    return ingest_available(spark, f"{sf_dir}/documents.parquet")
