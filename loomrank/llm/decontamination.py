"""Benchmark decontamination by template canonicalisation, hash-joined windows and slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, in_batches, staged, table, text_of

#: Tokens of a window, the plain words a template must have (with fewer, a window matches word for word only), and the tokens below which an item is too short to name.
WINDOW, MIN_PLAIN, MIN_ITEM = 8, 4, 3
#: Bits of the filter that is sent to every task: FILTER_BITS at most, else about 64 for each benchmark window. It only saves the shuffle of windows that can't match.
FILTER_BITS = 1 << 27
# Unit words.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec secs min mins h hr hrs ms second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kph watt watts volt volts joule joules".split())
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
MARKS = frozenset(".,;:!?)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: The code of a token that is punctuation only; a window of these alone never matches.
BLANK = np.uint64(xxhash.xxh3_64_intdigest(b"") | 8)
#: Tokens that a worker remembers before it starts anew.
REMEMBERED = 100_000


class Words(dict):
    """Numbers raw tokens, and knows of each by its number: hash of the bare word, kind by itself, and whether it ends a sentence. New ones are known from ``learn`` on."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.raw: list[str] = []
        self.code, self.kind, self.ends = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
        self.known = 0

    def __missing__(self, raw: str) -> int:
        i = self[raw] = len(self.raw)
        self.raw.append(raw)
        return i

    def learn(self) -> None:
        """Hashes and kinds of the tokens numbered since the last call, put into the arrays at once."""
        new = self.raw[self.known :]
        code, kind, ends = [], [], []
        for raw in new:
            # letters only, or with one mark at the end, need no pattern
            last = raw[-1:]
            word = raw if raw.isalpha() else raw[:-1] if last in MARKS and raw[:-1].isalpha() else None
            if word is not None:
                low = word.lower()
                kind.append(UNIT if low in UNITS else NAME if word[0].isupper() else PLAIN)
                code.append(xxhash.xxh3_64_intdigest(low) | 8)
                ends.append(word is not raw and last in ".!?")
                continue
            word = EDGE.sub("", raw)
            low = word.lower()
            kind.append(NUMBER if NUMERIC.fullmatch(raw.rstrip(".,;:!?)\"'")) else UNIT if low in UNITS else NAME if word[:1].isupper() else PLAIN)
            code.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | 8)
            ends.append(raw.rstrip("\"')").endswith((".", "!", "?")))
        n, self.known = self.known, len(self.raw)
        if self.known > len(self.code):
            room = 2 * self.known - n
            self.code, self.kind, self.ends = (np.concatenate([x[:n], np.empty(room - n, x.dtype)]) for x in (self.code, self.kind, self.ends))
        self.code[n : self.known], self.kind[n : self.known], self.ends[n : self.known] = np.array(code, np.uint64), kind, ends

    def bare(self, i: int) -> str:
        return EDGE.sub("", self.raw[i]).lower()


@lru_cache(maxsize=1)
def words_here() -> Words:
    return Words()


def mixed(code: np.ndarray, at: np.ndarray, size: int, seed: int = 0, first: np.ndarray | None = None) -> np.ndarray:
    """A hash of the ``size`` codes from each position in ``at``; ``first`` stands in for the codes at ``at`` itself."""
    out = np.full(len(at), size + seed, np.uint64)
    for i in range(size):
        out = (out ^ (code[at + i] if i or first is None else first)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def windows(text: str, sizes: list[int], verbatim: list[int], item: bool = False) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each size: (size, is verbatim, positions, hash of each window, kinds of tokens, tokens, tokens before the slots).

    Tokens are split at white space and bared of punctuation at the edges. In a template a number, a unit right after a
    number, and a capitalised word inside a sentence become typed placeholders. A capitalised word at the
    start of a window is read both ways in documents, as an item may begin there (after a colon, under a heading).
    Windows with fewer than MIN_PLAIN plain words have no template but match word for word: of an item only
    these are verbatim, of a document all (for the sizes in ``verbatim``), so no place is counted twice.
    """
    known = words_here()
    if len(known) > REMEMBERED:
        known.forget()
    raw = text.split()
    if not raw:
        return
    at = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    known.learn()
    kind, ends, words = known.kind[at], known.ends[at], known.code[at]
    begins = np.concatenate([[True], ends[:-1]])
    after_number = np.concatenate([[False], kind[:-1] == NUMBER])
    kind = np.where((kind == NAME) & begins, PLAIN, np.where((kind == UNIT) & ~after_number, PLAIN, kind))
    code = np.where(kind == PLAIN, words, kind.astype(np.uint64))
    plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    for size in sorted({*sizes, *verbatim}):
        n = len(at) - size + 1
        if n < 1:
            continue
        enough, count = min(MIN_PLAIN, size), plain[size:] - plain[:-size]
        if size in sizes:
            pos = np.flatnonzero(count >= enough)
            yield size, False, pos, mixed(code, pos, size), kind, at, 0
            if not item:
                pos = np.flatnonzero((kind[:n] == NAME) & (count + 1 >= enough))
                yield size, False, pos, mixed(code, pos, size, first=words[pos]), kind, at, 1
        if size in verbatim:
            said = np.concatenate([[0], np.cumsum(words != BLANK)])
            pos = np.flatnonzero((said[size:] > said[:-size]) & ((count < enough) | (not item)))
            yield size, True, pos, mixed(words, pos, size, 1 << 20), kind, at, size


def slots(kind: np.ndarray, at: np.ndarray, start: int, size: int) -> list[str]:
    """The values of a window's placeholders, with their type, in order."""
    bare = words_here().bare
    return [f"{kind[i]}{bare(at[i])}" for i in range(start, start + size) if kind[i] != PLAIN]


def item_windows(items: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(item_id, n_tokens, size, exact, window, item_pos, item_slots): windows of ``size`` tokens, of a shorter item the whole. Items under MIN_ITEM tokens have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                n = len(t.split())
                if n >= MIN_ITEM:
                    for s, exact, pos, h, kind, at, skip in windows(t, [min(n, size)], [min(n, size)], item=True):
                        out += [(item, n, s, exact, int(w), int(i), slots(kind, at, i + skip, s - skip)) for i, w in zip(pos, h)]
            kinds = [b.schema.field("item_id").type, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["item_id", "n_tokens", "size", "exact", "window", "item_pos", "item_slots"])

    rows = items.select(items["item_id"].alias("item_id"), text_of(items, text).alias("text"))
    return in_batches(rows, run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, n_tokens int, size int, exact boolean, window long, item_pos int, item_slots array<string>")


def window_filter(bench: DataFrame, bits: int) -> np.ndarray:
    """A bit for each benchmark window at its hash modulo the size, as at most bits / 64 longs; tasks build it, and other windows may share a bit."""
    size = 64
    while size < bits and size < 64 * bench.count():
        size *= 2
    slot = F.col("window").bitwiseAND(F.lit(size - 1))
    rows = bench.select(F.shiftright(slot, 6).alias("long"), F.expr(f"shiftleft(1L, cast((window & {size - 1}L) & 63 as int))").alias("bit")).groupBy("long").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(size // 64, np.int64)
    out[[r["long"] for r in rows]] = [r["bits"] for r in rows]
    return out


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, n_windows, exact_windows, first_pos, n_item_tokens.

    A window of the document matches one of the item when their templates are equal and the slot values
    map one to one (equal values to equal values, different to different). exact_windows counts those
    with the very same values, so n_windows > exact_windows marks a re-parameterised copy. Windows with
    fewer than MIN_PLAIN plain words match word for word only. Null and empty texts hold nothing, rows of equal doc_id
    count as one document, null ids pass through as null, and other columns are ignored. Empty tables give an empty result.
    """
    bench = staged(item_windows(items, size), "bench-windows")
    asked = bench.select("size", "exact").distinct().collect()  # at most twice ``size`` rows
    sizes, verbatim = (sorted(r["size"] for r in asked if r["exact"] == exact) for exact in (False, True))
    shared = docs.sparkSession.sparkContext.broadcast(window_filter(bench, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        mask = len(wanted) * 64 - 1
        for b in batches:
            out = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for s, _, pos, h, kind, at, skip in windows(t, sizes, verbatim):
                    slot = h & mask
                    use = np.flatnonzero((wanted[slot >> 6] >> (slot & 63)) & 1)
                    pos, h = pos[use], h[use]
                    out += [(doc, int(w), int(i), slots(kind, at, i + skip, s - skip)) for i, w in zip(pos, h)]
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "window", "pos", "doc_slots"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs, text).alias("text"))
    hits = in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, window long, pos int, doc_slots array<string>")
    pairs = F.size(F.array_distinct(F.arrays_zip("doc_slots", "item_slots")))
    one_to_one = (F.size("doc_slots") == F.size("item_slots")) & (pairs == F.size(F.array_distinct("doc_slots"))) & (pairs == F.size(F.array_distinct("item_slots")))
    return (
        hits.join(bench, "window")
        .where(one_to_one)
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("doc_slots") == F.col("item_slots")).alias("exact_windows"), F.min("pos").alias("first_pos"), F.max("n_tokens").alias("n_item_tokens"))
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    gone = staged(contaminated(docs, items).where("doc_id is not null").select("doc_id").distinct(), "bench-gone")
    return beside(docs, gone, "doc_id", "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
