"""Quality scores by Bradley-Terry pairwise ranking over whole-text features."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, done, in_batches, staged, table, text_of

#: Rows of a block, in which each row of label 1 meets each of label 0, and rows of the rarer label that a block has on average at least.
BLOCK, LEAST = 512, 16
#: Rounds of Newton's method, the weight of the ridge penalty, and bins in which strengths are counted for the threshold.
ROUNDS, RIDGE, BINS = 25, 1e-3, 1 << 14
ASCII = range(33, 127)


def features(text: str) -> np.ndarray:
    """Shares of each printable ASCII character, of classes of bytes, and shape of the words and lines, from the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(words), 1)
    distinct = len(set(words))
    plain = sum(map(bytes.isalpha, words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    shape = [
        upper, lower, seen[48:58].sum(), seen[128:].sum(), seen[32], seen[10], seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum(), upper / max(upper + lower, 1e-9),
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / k / 10, distinct / k, np.log1p(distinct), plain / k, repeats / k,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), np.log1p(max(map(len, lines), default=0)), np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([np.sqrt(seen[ASCII.start : ASCII.stop]), np.array(shape)])


WIDTH = len(features(""))


@dataclass(frozen=True)
class Ranker:
    """score(x) is the chance that x is preferred to a text right at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -6, 6) * self.weight).sum(axis=1)  # row by row: equal texts score equally

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold), -500, 500)))


def sums(blocks: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], how: Callable = np.add) -> np.ndarray:
    """``each(x, y, own)`` of every block as one array, added up (or put together by ``how``) in the tasks and then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for rows in b.column("rows"):
                x = rows.values.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                y, own = (rows.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "own"))
                got = np.concatenate([np.ravel(v) for v in each(x, y, own)])
                total = got if total is None else how(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([arrays([total.astype(float)])], ["total"])

    def arrays(lists: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.float64()))

    parts = sorted(r["total"] for r in in_batches(blocks.select("rows"), run, "total array<double>").collect())  # one for each task
    return reduce(how, map(np.array, parts))


def fit(blocks: DataFrame, n: int, good: int) -> Ranker:
    """Learns strengths from preference pairs (a row of label 1 over one of label 0) by logistic loss on feature differences.

    ``blocks(rows array<struct<x, y, own>>)`` are staged; within one, all pairs count, and rows that aren't ``own``
    are copies of the rarer label. ``n`` rows are labelled, ``good`` of them 1. The threshold is the quantile
    of all rows' strengths (counted in BINS bins) at the share of label 0, moved to the quantile with the best
    balanced accuracy among its neighbours. With one label only (or no rows) there is no pair: every text then
    scores by the labels' majority.
    """
    if good in (0, n):
        sure = 0.0 if n == 0 else (1.0 if good else -1.0)
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -sure, 1.0)
    mean = sums(blocks, lambda x, y, own: [x[own].sum(0)]) / n
    scale = np.maximum(np.sqrt(sums(blocks, lambda x, y, own: [((x[own] - mean) ** 2).sum(0)]) / n), 1e-3)

    def pairs(w: np.ndarray) -> Callable:
        def each(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
            z = np.clip((x - mean) / scale, -6, 6)
            a, b = z[y == 1], z[y == 0]
            p = 1 / (1 + np.exp(np.clip((a @ w)[:, None] - (b @ w)[None, :], -30, 30)))  # chance of the wrong order
            q = p * (1 - p)
            cross = a.T @ q @ b
            return [a.T @ p.sum(1) - b.T @ p.sum(0), (a * q.sum(1)[:, None]).T @ a + (b * q.sum(0)[:, None]).T @ b - cross - cross.T, np.array([p.size])]

        return each

    w = np.zeros(WIDTH)
    for _ in range(ROUNDS):
        got = sums(blocks, pairs(w))
        if not got[-1]:
            break
        step = np.linalg.solve(got[WIDTH:-1].reshape(WIDTH, WIDTH) / got[-1] + (RIDGE + 1e-6) * np.eye(WIDTH), got[:WIDTH] / got[-1] - RIDGE * w)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    ranker = Ranker(mean, scale, np.round(w, 9), 0.0, 1.0)
    low, high = sums(blocks, lambda x, y, own: [-ranker.strength(x).min(keepdims=True), ranker.strength(x).max(keepdims=True)], np.maximum) * [-1, 1]
    edges = np.linspace(low, high, BINS + 1)

    def counted(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        at = np.clip(np.searchsorted(edges, ranker.strength(x[own]), "right") - 1, 0, BINS - 1)
        return [np.bincount(at[y[own] == k], minlength=BINS) for k in (0, 1)]

    bad_under, good_under = (np.concatenate([[0], np.cumsum(c)]) for c in sums(blocks, counted).reshape(2, BINS))  # below each edge
    share = (n - good) / n
    marks = np.unique(np.clip(share + np.linspace(-0.15, 0.15, 121), 0.0005, 0.9995))
    cuts = np.clip(np.searchsorted(bad_under + good_under, marks * n, "left"), 1, BINS)
    balance = [((good - good_under[t]) / good + bad_under[t] / (n - good)) / 2 - 0.02 * abs(q - share) for t, q in zip(cuts, marks)]
    cut = edges[cuts[int(np.argmax(balance))]]

    # the middle of the gap below the cut, so that neither side's outermost text decides
    def sides(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        s = ranker.strength(x)
        return [s[s < cut].max(keepdims=True, initial=-np.inf), -s[s >= cut].min(keepdims=True, initial=np.inf)]

    below, above = sums(blocks, sides, np.maximum) * [1, -1]
    return replace(ranker, threshold=float((below + above) / 2) if np.isfinite(below) and np.isfinite(above) else float(cut))


def held_out(doc_id: "F.Column") -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Ranker:
    """Fits on all labelled documents whose crc32(doc_id) mod 3 is not 1. Their features are staged in blocks; only sums reach the driver."""
    marks = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    marks = staged(marks.where(~held_out(F.col("doc_id"))), "quality-marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = beside(docs.select(docs["doc_id"].alias("doc_id"), text_of(docs, text).alias("text")), marks, "doc_id", "inner")
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a repeated doc_id counts once
    found = staged(in_batches(rows.select("doc_id", "y", "text"), run, f"doc_id {kind}, y int, x array<double>").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")), "quality-features")
    n, good = found.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 1)).first()
    count = max(1, -(-n // BLOCK))
    rare = min(good, n - good)
    copies = min(count, max(1, -(-LEAST * count // max(rare, 1))))  # in all LEAST rows a block, so no block lacks the rarer label
    turns = F.when(F.col("y") == int(good <= n - good), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = found.select("doc_id", "y", "x", F.explode(turns).alias("turn")).withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(count)) + F.col("turn"), F.lit(count)))
    blocks = staged(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "turn", "y", (F.col("turn") == 0).alias("own"), "x"))).alias("rows")), "quality-blocks")
    ranker = fit(blocks, n, good)
    done(marks, found, blocks)
    return ranker


def scores(docs: DataFrame, ranker: Ranker, text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; the row's other columns before them with ``carry``."""
    rows = docs if carry else docs.select(docs["doc_id"].alias("doc_id"), text_of(docs, text).alias("text"))
    names = [*(rows.columns if carry else ["doc_id"]), "quality_score"]
    at = rows.columns.index(text if carry else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, WIDTH)
            out = list(b.columns) if carry else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ranker.score(x), pa.float64())], names)

    kept = rows.schema.fields if carry else rows.schema.fields[:1]
    return in_batches(rows, run, T.StructType([*kept, T.StructField("quality_score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text enters a score; null counts as empty, and equal texts score equally. A null doc_id isn't
    held out. Labels that are null or not 0 or 1 are passed over, of several for a document the lowest
    holds, and extra columns of either table are ignored. Empty tables give an empty result.
    """
    s = scores(docs, train(docs, labels, text), text)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at or above the threshold; their columns stay."""
    if "quality_score" in docs.columns:
        raise ValueError("docs must not have a column quality_score")
    return scores(docs, train(docs, labels, text), text, carry=True).where("quality_score >= 0.5").drop("quality_score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def is_held_out(doc_id: int) -> bool:
    """The same rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
