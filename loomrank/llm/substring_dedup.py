"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, done, fresh, in_batches, row_name, staged, table, text_of

#: A span starts at each sentence and takes the fewest sentences, SPAN at least, that have WORDS words: what is left
#: whole of a passage of 50 words that begins and ends inside other sentences.
SPAN, WORDS = 2, 20
#: A sentence with the white space after it: up to an end mark before white space, an ideographic end mark, or the end of a line.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|[。！？]+|(?=\n)|\Z)\s*", re.S)
#: A run without spaces counts as one word for each RUN characters, at least one.
RUN = 12


def sentences(text: str) -> list[str]:
    """The sentences; together they are the whole text."""
    return [s for s in SENTENCE.findall(text) if s]


def spans(parts: list[str], span: int, words: int) -> tuple[list[int], list[int], np.ndarray]:
    """(words of each sentence, last sentence of each span, 128-bit names of the spans as pairs of longs); sentences are compared in lower case with white space as one space."""
    cut = [p.lower().split() for p in parts]
    flat = [" ".join(c) for c in cut]
    count = [max(len(c), len(f) // RUN) for c, f in zip(cut, flat)]
    last, names, j, w, n = [], [], 0, 0, len(parts)
    for i in range(n):
        while j < n and (j - i < span or w < words):
            w += count[j]
            j += 1
        if j - i < span or w < words:
            break
        last.append(j - 1)
        names.append(xxhash.xxh3_128_digest("\x1e".join(flat[i:j]).encode("utf-8", "surrogatepass")))
        w -= count[i]
    return count, last, np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)


def stretches(chars: list[int], words: list[int], later: list[tuple[int, int]], first: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int, bool]]:
    """(first sentence, last sentence, start, end, words, kept): runs of sentences that spans in ``later`` cover, and runs that only those in ``first`` do (kept)."""
    n = len(chars)
    mark = np.zeros(n + 1, np.int64)
    for spans_, by in ((first, 1), (later, 1 << 32)):
        for a, b in spans_:
            mark[a] += by
            mark[b + 1] -= by
    mark = np.cumsum(mark)[:n]
    kind = np.where(mark >= 1 << 32, 2, np.where(mark > 0, 1, 0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]])))
    end = np.concatenate([[0], np.cumsum(chars)])
    total = np.concatenate([[0], np.cumsum(words)])
    return [(int(a), int(b) - 1, int(end[a]), int(end[b]), int(total[b] - total[a]), bool(kind[a] == 1)) for a, b in zip(edges, edges[1:]) if kind[a]]


def removals(docs: DataFrame, text: str = "text", span: int = SPAN, words: int = WORDS) -> DataFrame:
    """One row per repeated stretch: doc_id, r1, r2 (name the row by doc_id and text), kept, first_doc_ids, first_sentence, last_sentence, char_start, char_end, n_words.

    A span is a run of consecutive sentences, ``span`` at least and as many as make ``words`` words. Every
    span of every row is hashed (128 bits) and joined over all rows. A sentence goes when any span on it is not
    the first of its kind, by doc_id (null last), row name and position: kept is false, and first_doc_ids are the
    documents that have those spans first. Sentences under first ones of repeated spans only make stretches with kept true.
    Null and empty texts and texts shorter than a span have none. Rows of equal doc_id and text are one
    document; other columns are ignored; an empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, counts, lasts, h1, h2 = [], [], [], [], []
            for t in b.column("text").to_pylist():
                parts = sentences(t)
                count, last, names = spans(parts, span, words)
                chars.append([len(p) for p in parts])
                counts.append(count)
                lasts.append(last)
                h1.append(names[:, 0])
                h2.append(names[:, 1])
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("r1"), b.column("r2"), pa.array(chars, ints), pa.array(counts, ints), pa.array(lasts, ints), pa.array(h1, longs), pa.array(h2, longs)], ["doc_id", "r1", "r2", "chars", "words", "last", "h1", "h2"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), *row_name(docs, text), text_of(docs, text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cuts = staged(in_batches(rows, cut, f"doc_id {kind}, r1 long, r2 long, chars array<int>, words array<int>, last array<int>, h1 array<long>, h2 array<long>"), "span-cuts")
    # the first half of the names finds what can repeat, the whole decides
    busy = staged(cuts.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "span-busy")
    place = cuts.select("doc_id", "r1", "r2", F.posexplode(F.arrays_zip("h1", "h2", "last")).alias("pos", "s")).select("doc_id", "r1", "r2", "pos", "s.h1", "s.h2", "s.last")
    place = staged(beside(place, busy, "h1", "left_semi"), "span-places")
    done(busy)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "pos")
    first = place.groupBy("h1", "h2").agg(F.min(order).alias("at"), F.max(order).alias("end")).where("at <> end").select("h1", "h2", "at")
    first = staged(first, "span-first")
    is_first = (F.col("r1") == F.col("at.r1")) & (F.col("r2") == F.col("at.r2")) & (F.col("pos") == F.col("at.pos"))
    hits = place.join(first, ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_set(F.struct("pos", "last", is_first.alias("first"), F.col("at.doc_id").alias("from"))).alias("hits"))
    hits = staged(hits, "span-hits")
    done(place, first)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, r1, r2, chars, count, hit in zip(*(b.column(c).to_pylist() for c in ("doc_id", "r1", "r2", "chars", "words", "hits"))):
                later, own = [(h["pos"], h["last"], h["from"]) for h in hit if not h["first"]], [(h["pos"], h["last"]) for h in hit if h["first"]]
                for a, z, start, end, n, kept in stretches(chars, count, [h[:2] for h in later], own):
                    source = [] if kept else sorted({f for p, q, f in later if p <= z and q >= a and f is not None})
                    out.append((doc, r1, r2, kept, source, a, z, start, end, n))
            ids = b.schema.field("doc_id").type
            kinds = [ids, pa.int64(), pa.int64(), pa.bool_(), pa.list_(ids), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "r1", "r2", "kept", "first_doc_ids", "first_sentence", "last_sentence", "char_start", "char_end", "n_words"])

    both = beside(cuts.select("doc_id", "r1", "r2", "chars", "words"), hits, ["r1", "r2"], "inner")
    return in_batches(both, merge, f"doc_id {kind}, r1 long, r2 long, kept boolean, first_doc_ids array<{kind}>, first_sentence int, last_sentence int, char_start int, char_end int, n_words int")


def substring_dedup(docs: DataFrame, text: str = "text", span: int = SPAN, words: int = WORDS) -> DataFrame:
    """``docs`` with the stretches of ``removals`` that aren't kept cut from the text; all rows and columns stay."""
    r1, r2, cuts = fresh(docs, "r1"), fresh(docs, "r2"), fresh(docs, "cuts")
    gone = removals(docs, text, span, words).where("not kept").groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias(cuts))
    gone = staged(gone.select(F.col("r1").alias(r1), F.col("r2").alias(r2), cuts), "span-gone")
    x, y = row_name(docs, text)
    marked = beside(docs.withColumns({r1: x, r2: y}), gone, [r1, r2], "left")
    body, c = text_of(docs, text), F.col(cuts)
    starts = F.concat(F.array(F.lit(0)), F.transform(c, lambda x: x["char_end"]))
    stops = F.concat(F.transform(c, lambda x: x["char_start"]), F.array(F.length(body)))
    left = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(body, p["a"] + 1, p["b"] - p["a"])), "")
    return marked.withColumn(text, F.when(c.isNull(), F.col(text)).otherwise(left)).select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch that stands in the table more than once: those that go (kept false) and those that stay as the first."""
    return removals(table(spark, sf_dir, "documents")).drop("r1", "r2")
