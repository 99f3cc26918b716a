"""Search: dense, BM25, token overlap, reciprocal-rank fusion, hybrid retrieval, reranking, TF-IDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..functions import text as X
from ..functions import vectors as Vec
from ..functions import vocab as V

#: Rows of a side that may be sent to every task.
SENT = 100_000
#: Query tokens that may stand in a plan, to be looked up in the row.
FEW = 2_000


def small_side(df: DataFrame, most: int = SENT) -> DataFrame:
    """``df`` to be broadcast if it is counted to have at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def few(df: DataFrame, most: int = FEW) -> list | None:
    """The values of the one column of ``df`` if there are at most ``most``, else None."""
    rows = df.limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def top(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The first k rows of each key by falling score; adds rank from 1. Planned as a group limit before the shuffle.

    Scores are compared at 9 digits, so that the order in which a cluster adds floats can't change a rank.
    """
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.round(score, 9).desc(), tie))).where(F.col("rank") <= k)


def dense_topk(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries(query_id, q) against points(id, vector): dot(vector, q)/|q|, the first k of each query.

    Queries are the small side: they are broadcast while counted small, and each point partition keeps k
    candidates a query before anything is shuffled.
    """
    q = small_side(queries.select("query_id", "q", Vec.norm(F.col("q")).alias("qn")))
    scored = points.crossJoin(q).select("query_id", "id", F.coalesce(Vec.dot(F.col("vector"), F.col("q")) / F.nullif("qn", F.lit(0.0)), F.lit(0.0)).alias("score"))
    return top(scored, ["query_id"], "score", "id", k)


def bm25(chunks: DataFrame, queries: DataFrame, corpus: list[str], chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """Okapi scores of queries(query_id, text) against the chunks of each corpus: (query_id, corpus..., chunk, score > 0).

    Counts, lengths and the mean idf are of each corpus on its own (``corpus`` may be empty: one corpus).
    An idf that isn't positive counts as a quarter of the mean idf. Repeated query tokens count again.
    Only query tokens meet chunk tokens, in an inverted join; no chunk is compared with a query it shares nothing with.
    """
    one = corpus or ["_all"]
    base = chunks if corpus else chunks.withColumn("_all", F.lit(0))
    ids = [*one, chunk]
    q = small_side(Vec.token_counts(queries, ["query_id"]).select("query_id", "token", F.col("n").alias("qn")))
    words = q.select("token").distinct()
    known = few(words)
    # only query tokens leave the row's counts
    tf = Vec.token_counts(base, ids, text, known) if known is not None else Vec.token_counts(base, ids, text).join(small_side(words), "token", "left_semi")
    sizes = base.groupBy(*one).agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size(X.tokens(F.col(text)))).alias("avg_len"))

    def rarity(counts: DataFrame) -> DataFrame:
        raw = F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return counts.groupBy(*one, "token").agg(F.count(F.lit(1)).alias("df")).join(sizes, one).withColumn("raw", raw)

    idf = rarity(tf)
    # the mean is over all tokens, but only of a corpus that has a query token in over half of its chunks
    common = base.join(idf.where("raw < 0").select(*one).distinct(), one, "left_semi")
    mean = rarity(Vec.token_counts(common, ids, text)).groupBy(*one).agg(F.avg("raw").alias("mean"))
    idf = idf.join(mean, one, "left").select(*one, "token", "avg_len", F.when(F.col("raw") < 0, V.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    hits = tf.join(idf, [*one, "token"]).join(q, "token")
    weight = F.col("n") * (V.BM25_K1 + 1) / (F.col("n") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / F.col("avg_len")))
    out = hits.groupBy("query_id", *ids).agg(F.sum(F.col("qn") * F.col("idf") * weight).alias("score")).where("score > 0")
    return out if corpus else out.drop("_all")


def overlap_topk(chunks: DataFrame, queries: DataFrame, k: int, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """The first k chunks of each query by the number of distinct tokens in common, over 0."""
    c = chunks.select(chunk, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("token"))
    q = small_side(queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")))
    return top(c.join(q, "token").groupBy("query_id", chunk).agg(F.count(F.lit(1)).alias("score")), ["query_id"], "score", chunk, k)


def rrf(rankings: DataFrame, keys: list[str], item: str, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (keys..., item, rank from 1): the sum of 1/(k + rank) over the lists that have the item."""
    return rankings.groupBy(*keys, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused_score"))


def ranked_lists(chunks: DataFrame, queries: DataFrame, lists: tuple[str, ...] = ("dense", "lexical")) -> DataFrame:
    """(query_id, pos, candidate_id, chunk_id, rank, list): the first chunks of each query string and candidate, by list; see ``hybrid``."""
    strings = queries.select(F.struct("query_id", "pos").alias("query_id"), "text")
    ids, parts = ["candidate_id", "chunk_id"], []
    if "dense" in lists:
        wanted = small_side(Vec.bag_of_words(strings, ["query_id"]))
        vectors = Vec.bag_of_words(chunks, ids, only=few(wanted.select("dim").distinct()))
        sims = Vec.sparse_cosine(wanted, ["query_id"], vectors, ids)
        parts.append(top(sims, ["query_id", "candidate_id"], "sim", "chunk_id", V.DENSE_K).select("query_id", *ids, "rank", F.lit("dense").alias("list")))
    if "lexical" in lists:
        parts.append(top(bm25(chunks, strings, ["candidate_id"]), ["query_id", "candidate_id"], "score", "chunk_id", V.LEXICAL_K).select("query_id", *ids, "rank", F.lit("lexical").alias("list")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.pos").alias("pos"), *ids, "rank", "list")


def fuse(found: DataFrame, chunks: DataFrame, k: int, by: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """Ranked lists fused: the first k chunks of each (by..., requirement, candidate), with their section and, if wanted, text."""
    keys = [*by, "query_id"]
    ids = ["candidate_id", "chunk_id"]

    def first_rank(which: str) -> Column:
        return F.min_by(F.when(F.col("list") == which, F.col("rank")), F.when(F.col("list") == which, F.col("pos")))

    fused = found.groupBy(*keys, *ids).agg(F.sum(1.0 / (V.RRF_K + F.col("rank"))).alias("fused_score"), first_rank("dense").alias("dense_rank"), first_rank("lexical").alias("lexical_rank"))
    fused = fused.join(chunks.select(*ids, "section", *["text"] * texts), ids).withColumn("fused_score", F.when(F.col("section") == "skills", F.col("fused_score") * V.SKILLS_SECTION_FACTOR).otherwise(F.col("fused_score")))
    return top(fused, [*keys, "candidate_id"], "fused_score", "chunk_id", k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = V.DENSE_K, lists: tuple[str, ...] = ("dense", "lexical"), texts: bool = True) -> DataFrame:
    """The first k chunks of each (requirement, candidate): fused dense and BM25 lists of all its query strings.

    chunks(candidate_id, chunk_id, section, text); queries(query_id, pos, text), pos from 0 naming the strings of
    a requirement. Dense: cosine of hashed bags of words, only chunks that share a token. A chunk of a skills
    section has half its fused score. dense_rank and lexical_rank are those of the first query string that found it.
    """
    return fuse(ranked_lists(chunks, queries, lists), chunks, k, texts=texts)


#: A pair scorer gives a logit for a query text and a text.
PairScorer = Callable[[Column, Column], Column]


def lexical_scorer(query: Column, text: Column) -> Column:
    """The stand-in scorer: 8 times the F1 of distinct tokens, less 2."""
    a, b = F.array_distinct(X.tokens(query)), F.array_distinct(X.tokens(text))
    total = F.size(a) + F.size(b)
    return 8.0 * F.coalesce(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(total, F.lit(0)), F.lit(0.0)) - 2.0


def rerank(spans: DataFrame, query: str, keys: list[str], k: int = V.RERANK_K, scorer: PairScorer = lexical_scorer, floor: float | None = V.SPAN_FLOOR) -> DataFrame:
    """Scores spans by the pair scorer, squashed; the first k of each key, and of those the ones at or above the floor."""
    scored = spans.withColumn("ce_score", S.squashed(scorer(F.col(query), F.col("text"))))
    out = top(scored.drop("rank"), keys, "ce_score", "chunk_id", k)
    return out if floor is None else out.where(F.col("ce_score") >= floor)


def tfidf_rank(docs: DataFrame, query: str, doc: str = "doc_id", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """Cosine of each document with a query text under smooth idf ln((1 + n)/(1 + df)) + 1 over both; only shared tokens are joined."""
    spark = docs.sparkSession
    tf = Vec.token_counts(docs, [doc], text).where(F.length("token") > 1)
    q = Vec.token_counts(spark.range(1).select(F.lit(query).alias("text")), [], "text").where(F.length("token") > 1).select("token", F.col("n").alias("qn"))
    if stop:
        tf, q = tf.where(~F.col("token").isin(stop)), q.where(~F.col("token").isin(stop))
    n = docs.agg((F.count(F.lit(1)) + 1).alias("docs"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(q), "token", "full").select("token", (F.coalesce("df", F.lit(0)) + F.when(F.col("qn").isNull(), 0).otherwise(1)).alias("df"), "qn")
    idf = df.crossJoin(F.broadcast(n)).select("token", "qn", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    qlen = idf.where("qn is not null").agg(F.sqrt(F.sum(F.pow(F.col("qn") * F.col("idf"), 2))).alias("qlen"))
    scored = tf.join(idf, "token").groupBy(doc).agg(F.sum(F.col("n") * F.col("idf") * F.coalesce("qn", F.lit(0)) * F.col("idf")).alias("dot"), F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("len"))
    return docs.select(doc).join(scored.crossJoin(F.broadcast(qlen)), doc, "left").select(doc, F.coalesce(F.col("dot") / F.nullif(F.col("len") * F.col("qlen"), F.lit(0.0)), F.lit(0.0)).alias("score"))
