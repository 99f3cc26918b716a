"""Fuzzy line dedup by MinHash: shingle signatures, banding, exact Jaccard, union-find (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, done, fresh, once, row_name, small, staged, table, text_of
from .components import components, flagged, joined, links

#: Characters of a shingle.
WIDTH = 8
#: Shingles start where the content says: at the start of each run without spaces, and inside it at every character
#: that has WIDTH more of the run behind it; so every character is in some shingle, and an insertion moves no other start.
ANCHOR = r"(?s)(?=(.{1,%d}))(?:[^ ](?=[^ ]{%d})|[^ ]++ ?)"
#: A signature is the smallest SIGNATURE hashes of all shingles of a line; most lines have them among the smallest LOW with repeats. Bands are three neighbours of it.
SIGNATURE, LOW = 10, 24
#: Of shingles at every character, those that start with a space come first in the order of a signature. PICKED finds what
#: they have after it. A line that has SIGNATURE of them, as most long ones have, needs no others.
PICKED = r"(?s) (?=(.{%d}))"
#: Percent by which a signature's estimate may lie below the threshold, and rounds of hubs.
ROOM, ROUNDS = 30, 1
#: White space that becomes one space (lines are cut at line feeds before).
WHITE = r"[ \t\x0B\f\r]+"


def normal(text: Column) -> Column:
    """Lower case, white space other than line feeds as one space. The pattern runs only where there is something to replace."""
    some = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.lower(F.when(some, F.regexp_replace(text, WHITE, " ")).otherwise(text))


def pieces(line: Column, make: Callable[[Column], Column], width: int = WIDTH, every: bool = False) -> Column:
    """The hashes that ``make`` gives of a normalised line's shingles, with repeats: at ``every`` character that has ``width`` from it on, a line under ``width`` being one, or where ANCHOR says; there one at the end may be shorter."""
    if not every:
        return F.transform(F.regexp_extract_all(line, F.lit(ANCHOR % (width, width)), F.lit(1)), lambda s: make(s))

    def cut(wide: Column) -> Column:  # four bytes a character, so a shingle is found without counting characters
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 4 * width + 1, F.lit(1)), F.lit(4))
        return F.transform(starts, lambda i: make(F.substr(wide, i, F.lit(4 * width))))

    return once(F.encode(line, "UTF-32"), cut)


def shingles(line: Column, width: int = WIDTH, every: bool = False) -> Column:
    """Distinct hashes of the shingles of a normalised line."""
    return F.array_distinct(pieces(line, F.xxhash64, width, every))


def least(all_: Column) -> Column:
    """The SIGNATURE first distinct of sorted hashes of shingles. Only lines of many repeats are rid of these as a whole."""
    low = F.array_distinct(F.slice(all_, 1, LOW))
    return F.slice(F.when((F.size(low) < SIGNATURE) & (F.size(all_) > LOW), F.array_distinct(all_)).otherwise(low), 1, SIGNATURE)


def smallest(found: Column) -> Column:
    """The SIGNATURE smallest distinct of the hashes of shingles, in order."""
    return once(F.sort_array(found), least)


def spaced(line: Column, width: int = WIDTH) -> Column:
    """Hashes, all negative, of a normalised line's shingles that start with a space."""
    return F.transform(F.regexp_extract_all(line, F.lit(PICKED % (width - 1)), F.lit(1)), lambda s: F.hash(s).bitwiseOR(F.lit(-(2**31))))


def signature(line: Column, width: int = WIDTH, picked: Column | None = None) -> Column:
    """The SIGNATURE first distinct of the hashes of all shingles of a normalised line, at every character: negative ones of shingles that start with a space (``picked``, where a column has the smallest of these), then the others, each in order."""
    most = F.lit(2**31 - 1)

    def other(shingle: Column) -> Column:  # one that is picked counts as the largest hash, which goes; a line under ``width`` is one shingle and none is picked in it
        first = (F.substr(shingle, F.lit(1), F.lit(4)) == F.lit(" ".encode("utf-32-be"))) & (F.octet_length(shingle) == 4 * width)
        return F.when(first, most).otherwise(F.hash(shingle).bitwiseAND(most))

    def of(picked: Column) -> Column:
        rest = F.array_remove(smallest(pieces(line, other, width, True)), most)
        return F.when(F.size(picked) >= SIGNATURE, picked).otherwise(F.slice(F.concat(picked, rest), 1, SIGNATURE))

    return once(smallest(spaced(line, width)), of) if picked is None else of(picked)


def with_signature(lines: DataFrame, width: int, every: bool) -> DataFrame:
    """``lines`` with ``hashes``, the signature, in place of ``line``. Sorting and picking stand in columns of their own, outside lambdas, where Spark makes code on plain integers of them."""
    own = [c for c in lines.columns if c != "line"]
    if not every:
        return lines.select(*own, smallest(pieces(F.col("line"), F.hash, width)).alias("hashes"))
    lines = lines.withColumn("sorted", F.sort_array(spaced(F.col("line"), width)))
    lines = lines.select(*own, "line", least(F.col("sorted")).alias("picked"))
    return lines.select(*own, signature(F.col("line"), width, F.col("picked")).alias("hashes"))


def bands(signature: list[str], size: int) -> Column:
    """The keys of a signature: each ``size`` neighbours in hash order; of a shorter signature all values. They move with the values, so an inserted value spoils only its own bands."""
    runs = F.array(*[F.xxhash64(*run) for run in zip(*(signature[i:] for i in range(size)))])
    short = F.col(signature[size - 1]).isNull()
    return F.when(short, F.array(F.xxhash64(*signature[: size - 1]))).when(F.col(signature[-1]).isNotNull(), runs).otherwise(F.slice(runs, F.lit(1), F.greatest(length(signature) - (size - 1), F.lit(1))))


def length(signature: list[str]) -> Column:
    """How many values a signature has; nulls stand at its end."""
    return reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in signature])


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, r1, r2, pos, line) for each line that isn't blank, normalised."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), *row_name(docs, text), normal(text_of(docs, text)).alias("text"))
    return rows.select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "r1", "r2", "pos", F.trim("raw").alias("line")).where("line <> ''")


def with_first(rows: DataFrame, copies: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (h1, h2, ...) with ``first`` of the staged ``copies`` (h1, h2, first), else null, and a staged filter or none. Where ``copies`` are too many for every task, only rows that a filter of bounded size takes for one of them are shuffled."""
    if small(copies):
        return rows.join(F.broadcast(copies), ["h1", "h2"], "left"), None
    maybe, bits = flagged(rows.withColumn("key", F.col("h1")), copies.select(F.col("h1").alias("key")), label)
    maybe = maybe.drop("key")
    others = maybe.where("not has").drop("has").withColumn("first", F.lit(None).cast("long"))
    return maybe.where("has").drop("has").join(copies, ["h1", "h2"], "left").unionByName(others), bits


def line_classes(docs: DataFrame, percent: int = 80, text: str = "text", width: int = WIDTH, every: bool = False) -> DataFrame:
    """One row per line that isn't blank: doc_id, r1, r2, pos, keep_doc_id, keep_pos, kept.

    Two lines are alike when the Jaccard similarity of their sets of shingles (at ``every`` character, else
    where ANCHOR says) is at least ``percent``/100, after lower case and with white space as one space. Equal lines become one
    class, however short. A line (from 0) stays when it is the first of its component by doc_id, then
    position (a null doc_id comes last). Blank lines are left alone and have no row. Null texts are empty.
    Rows with equal doc_id and text are one document. Other columns are ignored; an empty table gives no rows.
    Of links, those at the very threshold are found with a chance of about 0.96 (bands), nearer ones with more;
    every link used is exact.
    """
    sig = [f"s{i}" for i in range(SIGNATURE)]
    lines = lines_of(docs, text).select("doc_id", "r1", "r2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "line")
    lines = with_signature(lines, width, every)
    lines = lines.select("doc_id", "r1", "r2", "pos", "h1", "h2", *[F.get("hashes", F.lit(i)).alias(c) for i, c in enumerate(sig)])
    at = staged(lines.withColumn("id", F.monotonically_increasing_id()), "line-all")
    # equal lines: names and counts alone are shuffled, and signatures stay where they are
    copies = at.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    copies = staged(copies, "line-copies")
    parts, bits = with_first(at.select("id", "h1", "h2", *sig), copies, "line")
    distinct = staged(parts.where("first is null or first = id").select("id", *sig), "line-distinct")
    done(bits)
    nodes = distinct.select("id", *sig, F.slice(F.array(*sig), F.lit(1), length(sig)).alias("sketch"))

    def values_of(ids: DataFrame) -> DataFrame:
        where = staged(beside(at.select("id", "r1", "r2", "pos"), ids, "id", "left_semi").select("r1", "r2", F.struct("id", "pos").alias("w")).groupBy("r1", "r2").agg(F.collect_list("w").alias("wanted")), "line-where")
        rows = docs.select(*row_name(docs, text), normal(text_of(docs, text)).alias("text"))
        return beside(rows, where, ["r1", "r2"], "inner").select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w")).select("w.id", F.trim(F.get("all", F.col("w.pos"))).alias("values"))

    found: list[DataFrame] = links(nodes, [bands(sig, 3)], F.lit(SIGNATURE), values_of, percent, SIGNATURE, "line", room=ROOM, rounds=ROUNDS, unpack=lambda line: shingles(line, width, every), sift=True, spent=distinct)
    comp = components(joined(found, at.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)), "line-cc")
    done(*found)
    # only lines that repeat or have links can lose their place
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "pos", "id")
    parts, bits = with_first(at.drop(*sig), copies, "line")
    some = beside(parts.withColumn("rep", F.coalesce("first", "id")), comp.withColumnRenamed("id", "rep"), "rep", "left").where("first is not null or comp is not null")
    some = staged(some.select("h1", "h2", order.alias("at"), "first", "rep", F.coalesce("comp", "rep").alias("comp")), "line-some")
    done(comp, bits, copies)
    heads = some.groupBy("comp").agg(F.min("at").alias("head"))
    one = some.where("rep = at.id")  # of equal lines
    keep = staged(one.join(heads, "comp").where("first is not null or at <> head").select("h1", "h2", F.col("head.r1").alias("k1"), F.col("head.r2").alias("k2"), F.col("head.doc_id").alias("keep_doc_id"), F.col("head.pos").alias("keep_pos")), "line-keep")
    done(some)
    own = F.col("k1").isNull()
    return beside(at.drop("id", *sig), keep, ["h1", "h2"], "left").select(
        "doc_id", "r1", "r2", "pos", F.when(own, F.col("doc_id")).otherwise(F.col("keep_doc_id")).alias("keep_doc_id"), F.coalesce("keep_pos", "pos").alias("keep_pos"),
        (own | ((F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")) & (F.col("pos") == F.col("keep_pos")))).alias("kept"),
    )


def line_dedup(docs: DataFrame, percent: int = 80, text: str = "text", every: bool = False) -> DataFrame:
    """``docs`` without the lines that ``line_classes`` doesn't keep; all rows and columns stay, other texts as they are."""
    r1, r2, drop = fresh(docs, "r1"), fresh(docs, "r2"), fresh(docs, "drop")
    gone = line_classes(docs, percent, text, every=every).where("not kept").groupBy("r1", "r2").agg(F.collect_set("pos").alias("pos"))
    gone = staged(gone.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("pos").alias(drop)), "line-gone")
    a, b = row_name(docs, text)
    marked = beside(docs.withColumns({r1: a, r2: b}), gone, [r1, r2], "left")
    left = F.array_join(F.filter(F.split(text_of(docs, text), "\n"), lambda line, i: ~F.array_contains(F.col(drop), i)), "\n")
    return marked.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(left)).select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't blank with the line that its component keeps, by shingles at every character."""
    return line_classes(table(spark, sf_dir, "documents"), every=True).select("doc_id", F.col("pos").alias("line_no"), "keep_doc_id", F.col("keep_pos").alias("keep_line_no"), "kept")
