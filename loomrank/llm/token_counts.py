"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table, text_of

SPACE = "▁"
#: A stretch that no merge can leave: all pieces have their space marks in front. A line feed never merges.
STRETCH = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
REMEMBERED = 400_000


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceMerger:
    """Counts the pieces that a sentencepiece BPE model makes of a text.

    The vocabulary gives each piece a rank. A stretch starts as a linked list of its characters; the
    adjacent pair whose union has the lowest rank (leftmost first on a tie) is merged until none is left.
    The count is the symbols at the start less the merges, plus what single characters that the
    vocabulary lacks need as bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or any("\n" in p and len(p) > 1 for p in self.rank):
            raise ValueError("this vocabulary has pieces that cross the stretches texts are cut into")
        self.alone = {p for p in self.rank if len(p) == 1}
        self.known: dict[str, int] = {}

    def stretch(self, s: str) -> int:
        rank, n = self.rank.get, len(s)
        start, end = list(range(n)), list(range(1, n + 1))  # live symbol i covers s[start[i]:end[i]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := after[i]) < 0 or end[j] != stop:
                continue  # one side has been merged since
            merges += 1
            gone[j], end[i], after[i] = 1, stop, after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if (r := rank(s[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (k := before[i]) >= 0 and (r := rank(s[start[k] : stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        extra = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in s if c not in self.alone) if not self.alone.issuperset(s) else 0
        return n - merges + extra

    def count(self, text: str) -> int:
        """Pieces of the whole text; 0 for an empty one."""
        if not text:
            return 0
        known, total = self.known, 0
        for s in STRETCH.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(s)
            if n is None:
                n = self.stretch(s)
                if len(s) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, from the whole text.

    Counts equal those of the library for the model, without begin or end marks; special strings inside a
    text are ordinary characters. Null and empty texts have 0 of both. Rows with equal or null doc_id are
    counted each for itself; further columns are ignored. ``model`` must be a path that all executors
    have; None takes the installed vocabulary.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model or model_file())
        for b in batches:
            n = pa.array([m.count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs, text).alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
