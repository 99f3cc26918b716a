"""The full chunker on words with offsets: lines, sections, bullets, ranges of at most CHUNK_TOKENS tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import content_id

TRIMS = " \t\r\n" + V.BULLETS
HEADERS = [(re.compile(rf"(?<!\w){re.escape(w)}(?!\w)"), label) for w, label in V.SECTION_HEADERS]
MARKER = re.compile(r"[ \t]*(?:[-*▪○]|\d{1,2}[.)]|\(\d{1,2}\))(?=\s)")
TOKEN = re.compile(r"\S+")


def header(line: str) -> str | None:
    norm = " ".join(line.lower().split()).strip(" -" + V.BULLETS)
    if len(norm.split()) > 6 or not re.search("[a-z]", norm) or line.strip()[:1] in tuple(V.BULLETS):
        return None
    return next((label for p, label in HEADERS if p.search(norm)), None)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip(TRIMS)), end - (len(piece) - len(piece.rstrip(TRIMS)))


def cut(text: str, start: int, end: int, at: list[int]) -> list[tuple[int, int]]:
    marks = [start, *[p for p in at if start < p < end], end]
    spans = (trimmed(text, a, b) for a, b in zip(marks, marks[1:]))
    return [(a, b) for a, b in spans if a < b]


def section_ranges(text: str, start: int, end: int, label: str) -> list[tuple[int, int]]:
    """Ranges of a section: list items, then bullet characters, then lines and commas; "other" by sentence windows of three with one shared."""
    body = text[start:end]
    if label == "other":
        sentences = cut(text, start, end, [start + m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n+", body)])
        return [(sentences[i][0], sentences[min(i + 2, len(sentences) - 1)][1]) for i in range(0, len(sentences), 2)]
    starts = [start + m.start() for m in re.finditer(r"(?m)^.*$", body) if MARKER.match(m[0])]
    for marks in (starts, [start + i for i, c in enumerate(body) if c in V.BULLETS], [start + i + 1 for i, c in enumerate(body) if c in ",\n"]):
        parts = cut(text, start, end, marks)
        if len(parts) > 1:
            return parts
    return parts


def sized(text: str, ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Merges neighbours up to ``most`` tokens and cuts what is longer."""
    pieces = []
    for a, b in ranges:
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        pieces += [(g[0][0], g[-1][1], len(g)) for i in range(0, len(tokens), most) if (g := tokens[i : i + most])]
    out: list[tuple[int, int, int]] = []
    for a, b, n in pieces:
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    # windows that share a sentence can make a merged range longer than its sum says
    final = []
    for a, b, _ in out:
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        final += [(g[0][0], g[-1][1]) for i in range(0, len(tokens), most) if (g := tokens[i : i + most])]
    return final


def chunk_ranges(text: str, most: int = V.CHUNK_TOKENS) -> list[tuple[str, int, int]]:
    """(section type, start, end) of each chunk; text[start:end] is the chunk."""
    parts, label, at, pos = [], "other", 0, 0
    for line in text.splitlines(keepends=True):
        if (name := header(line)) is not None:
            parts.append((label, at, pos))
            label, at = name, pos + len(line)
        pos += len(line)
    parts.append((label, at, len(text)))
    return [(label, a, b) for label, s, e in parts if text[s:e].strip(TRIMS) for a, b in sized(text, section_ranges(text, s, e, label), most)]


def chunk_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per chunk: doc, candidate_id, chunk_id, ordinal, section_type, char_start, char_end, n_tokens, raw_text.

    Order-dependent parsing runs in Python on Arrow batches, one document at a time; ids are made in the plan.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, c, i, s, a, e, len(t[a:e].split()), t[a:e]) for d, c, t in zip(b["doc"], b["candidate_id"], b["text"]) for i, (s, a, e) in enumerate(chunk_ranges(t))]
            yield pd.DataFrame(rows, columns=["doc", "candidate_id", "ordinal", "section_type", "char_start", "char_end", "n_tokens", "raw_text"])

    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).withColumn("candidate_id", content_id(F.col("text")))
    out = rows.mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, candidate_id string, ordinal int, section_type string, char_start int, char_end int, n_tokens int, raw_text string")
    return out.select(F.col("doc").alias(doc), "candidate_id", F.concat_ws(":", F.substring("candidate_id", 1, 8), F.format_string("%02d", "ordinal")).alias("chunk_id"), "ordinal", "section_type", "char_start", "char_end", "n_tokens", "raw_text")


def page_rows(words: pa.Table, tolerance: float) -> pa.RecordBatch:
    """The lines of whole pages, whose words stand together: see ``page_lines``."""
    def numbers(name: str) -> np.ndarray:
        return pc.fill_null(words[name].cast(pa.float64()), float("nan")).to_numpy()

    x0, top, height = numbers("x0"), numbers("doctop"), numbers("height")
    new = changes(words)
    first, page = np.flatnonzero(new), np.cumsum(new) - 1
    # columns, as by sections.column_split
    order = np.lexsort((x0, page))
    gap = np.where(np.append(new[1:], True), -1.0, np.append(np.diff(x0[order]), -1.0))
    widest = np.maximum.reduceat(gap, first)
    at = np.flatnonzero(gap == widest[page])
    at = at[np.diff(page[at], prepend=-1) > 0]
    a, b = np.full(len(first), np.nan), np.full(len(first), np.nan)
    a[page[at]], b[page[at]] = x0[order][at], x0[order][np.minimum(at + 1, len(x0) - 1)]
    sides = np.minimum(np.add.reduceat((x0 < a[page]).astype(int), first), np.add.reduceat((x0 > b[page]).astype(int), first))
    split = np.where((widest >= V.COLUMN_GAP) & (sides >= V.COLUMN_TOKENS), (a + b) / 2, np.nan)
    col = (x0 > split[page]).astype(np.int32)
    # the median of the heights below 20, 10 if there is none
    low = np.add.reduceat((height < 20).astype(int), first)
    median = np.where(low > 0, height[np.lexsort((height, page))][np.minimum(first + low // 2, len(x0) - 1)], 10.0)
    # words at the same height of a column are one step of the running mean
    order = np.lexsort((words["i"].to_numpy(), x0, top, col, page))
    o_page, o_col, o_top = page[order], col[order], top[order]
    steps = np.flatnonzero((np.diff(o_page, prepend=-1) != 0) | (np.diff(o_col, prepend=-1) != 0) | (np.diff(o_top, prepend=np.nan) != 0))
    starts, lines, at_page, at_col, line, mean, n = [], [], -1, -1, 0, 0.0, 0
    for start, k, p, c, t in zip(steps.tolist(), np.diff(steps, append=len(order)).tolist(), o_page[steps].tolist(), o_col[steps].tolist(), o_top[steps].tolist()):
        if p == at_page and c == at_col and abs(t - mean) <= tolerance:
            mean, n = (mean * n + t * k) / (n + k), n + k
            continue
        line = line + 1 if p == at_page else 0
        starts.append(start)
        lines.append(line)
        at_page, at_col, mean, n = p, c, t, k
    where = order[starts]
    texts = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), words["text"].cast(pa.string()).take(pa.array(order)).combine_chunks())
    columns = [words["doc_id"].take(pa.array(where)).combine_chunks(), words["page"].take(pa.array(where)).combine_chunks(), pa.array(col[where]), pa.array(lines, pa.int32()), pc.binary_join(texts, " "), pa.array(median[page[where]])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "col", "line", "text", "body_height"])


def changes(words: pa.Table) -> np.ndarray:
    """Where a word is the first of its page."""
    new = np.zeros(len(words), bool)
    new[:1] = True
    for name in ("doc_id", "page"):
        c = words[name]
        for values in (pc.fill_null(c, 0).to_numpy(), c.is_null().to_numpy()):
            new[1:] |= values[1:] != values[:-1]
    return new


def page_lines(words: DataFrame, tolerance: float = V.LINE_TOLERANCE) -> DataFrame:
    """words(doc_id, page, i, text, x0, doctop, height) to lines in reading order: left column first on pages of two columns.

    A word joins the line whose running mean of doctop is within ``tolerance``. Words come sorted by page, and all whole pages
    of an Arrow batch are handled at once; what is held is a batch and one page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b] if held else [b])
            cuts = np.flatnonzero(changes(both)[1:]) + (0 if held else 1)
            if len(cuts):
                # the last page may go on in the next batch
                yield page_rows(pa.Table.from_batches([*held, b.slice(0, cuts[-1])]), tolerance)
                held = [b.slice(cuts[-1])]
            else:
                held.append(b)
        if held:
            yield page_rows(pa.Table.from_batches(held), tolerance)

    placed = words.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "i", "text", "x0", "doctop", "height")
    return placed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(run, "doc_id long, page int, col int, line int, text string, body_height double")
