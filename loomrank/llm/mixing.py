"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only)."""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

#: Documents of a block, slots of a period, and hash buckets that a source is ranked in.
BLOCK, PERIOD, BUCKETS = 16, 1000, 1024
#: Most slots of a period of given weights.
SLOTS = 100_000


def shares(counts: dict[str, int], weights: dict[str, float] | None = None, period: int = PERIOD) -> dict[str, int]:
    """Whole slots of each source in a period.

    Without ``weights`` they go by the square roots of the counts: largest remainders over ``period``, at least one each.
    Given weights are read as the decimal numbers that they print as, and the period becomes as long as they need to
    be met exactly: deviation is then against the weights themselves. Only where that takes more than SLOTS slots are
    they rounded to that many, at least one for each weight above 0. A source of weight 0, or without one, gets none.
    """
    names = sorted(counts)
    if weights is not None:
        return given_shares(names, weights)
    period = max(period, 10 * len(names))
    raw = {s: math.sqrt(counts[s]) for s in names}
    total = sum(raw.values()) or 1.0
    exact = {s: raw[s] / total * (period - len(names)) for s in names}
    units = {s: 1 + math.floor(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (-(exact[s] - math.floor(exact[s])), s))[: period - sum(units.values())]:
        units[s] += 1
    return units


def given_shares(names: list[str], weights: dict[str, float], most: int = SLOTS) -> dict[str, int]:
    """See ``shares``. Weights that are negative or no numbers, or all 0 while there are sources, raise an error."""
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    raw = {s: Fraction(str(weights.get(s, 0))) for s in names}
    total = sum(raw.values())
    if not names:
        return {}
    if not total:
        raise ValueError("no source has a weight above 0")
    exact = {s: w / total for s, w in raw.items()}
    period = math.lcm(*(w.denominator for w in exact.values()))
    if period <= most:
        return {s: int(w * period) for s, w in exact.items()}
    units = {s: max(math.floor(w * most), 1 if w else 0) for s, w in exact.items()}
    for s in sorted((s for s in names if exact[s]), key=lambda s: (units[s] - exact[s] * most, s))[: max(most - sum(units.values()), 0)]:
        units[s] += 1
    return units


def schedule(units: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, k, slot) for a period of sum(units) slots.

    Block k (from 0) of a source with u slots is released at floor(k * period / u) and due at
    ceil((k + 1) * period / u). Each slot takes the released block that is due first, ties by name. As the
    shares fill the period, no block is late, so every source stays within one block of its share.
    """
    period, out, ready = sum(units.values()), [], []
    waiting = [(0, s, 0) for s in sorted(units) if units[s]]
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // units[s]), s, k))
        due, s, k = heapq.heappop(ready)
        assert slot < due
        out.append((s, k, slot))
        if k + 1 < units[s]:
            heapq.heappush(waiting, ((k + 1) * period // units[s], s, k + 1))
    return out


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block: int = BLOCK, period: int = PERIOD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, share, block, place, release, deadline, slot; order by slot, place to read the mix.

    A source's documents stand in the order of the MD5 of their id and are cut into blocks. Blocks take the
    slots of the period's schedule, period after period. All rows stay: when a source has run out its slots
    are empty, and until then every source is within one block of its share. Rows of a source without a
    share have null in release, deadline and slot: they are not in the mix. A null source is the source
    "". Rows of equal id follow each other in any order. Names of sources are few (they are fetched with
    their counts); a source is ranked in ``buckets`` parts, so no task gets a source whole. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), F.coalesce(F.md5(docs["doc_id"].cast("string")), F.lit("")).alias("hash"))
    rows = rows.withColumn("bucket", F.coalesce(F.conv(F.substring("hash", 1, 4), 16, 10).cast("int"), F.lit(0)) % buckets)
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    units = shares({r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}, weights, period)
    total = sum(units.values())
    before = counts.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    plan = schedule(units)
    share = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).alias("number"), F.lit(u).cast("long").alias("share")) for i, (s, u) in enumerate(units.items())]))) if units else spark.sql("SELECT '' AS source, 0 AS number, 1L AS share WHERE false")
    number = {s: i for i, s in enumerate(units)}
    # one literal, whatever the number of slots
    slots = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"number": number[s], "k": k, "offset": slot} for s, k, slot in plan])), "array<struct<number:int,k:bigint,offset:bigint>>")))
    # share and slots have a row per source and per slot of a period
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "bucket").orderBy("hash", "doc_id")) - 1)
    at = ranked.join(before, ["source", "bucket"]).join(F.broadcast(share), "source").withColumn("at", F.col("before") + F.col("rank"))
    at = at.withColumn("block", F.floor(F.col("at") / block)).withColumn("k", F.col("block") % F.nullif("share", F.lit(0)))
    at = at.join(F.broadcast(slots), ["number", "k"], "left")
    cycle = F.floor(F.col("block") / F.nullif("share", F.lit(0)))
    return at.select(
        "doc_id", "source", "share", "block", (F.col("at") % block).cast("int").alias("place"),
        F.expr(f"block * {total} div nullif(share, 0)").alias("release"),
        F.expr(f"((block + 1) * {total} + share - 1) div nullif(share, 0)").alias("deadline"),
        (cycle * total + F.col("offset")).alias("slot"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS source, count(*) AS c FROM documents GROUP BY 1),
m AS (SELECT count(*) AS m, greatest({PERIOD}, 10 * count(*)) AS period, sum(sqrt(c)) AS total FROM n),
e AS (SELECT source, sqrt(c) / total * (period - m) AS exact, m, period FROM n, m),
u AS (SELECT source, 1 + floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, source) <= period - (SELECT sum(1 + floor(exact)::BIGINT) FROM e) THEN 1 ELSE 0 END AS share, period FROM e),
l AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares, min(period)::BIGINT AS period, list(0 ORDER BY source) AS zero FROM u),
s AS (
  SELECT -1::BIGINT AS slot, zero AS done, 0::BIGINT AS pick FROM l
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT s.slot, s.done, (SELECT arg_min(i, (((s.done[i] + 1) * period + shares[i] - 1) // shares[i]) * 10000 + i) FROM range(1, len(shares) + 1) t(i) WHERE s.done[i] < shares[i] AND (s.done[i] * period) // shares[i] <= s.slot + 1) AS p
    FROM s, l WHERE s.slot + 1 < period) q
),
f AS (SELECT names[pick] AS source, done[pick] - 1 AS k, slot AS off FROM s, l WHERE slot >= 0),
d AS (SELECT doc_id, coalesce(source, '') AS source, md5(doc_id::VARCHAR) AS h FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || h[1:4])::INT % {BUCKETS}, h, doc_id) - 1 AS pos FROM d)
SELECT doc_id, source, share, pos // {BLOCK} AS block, (pos % {BLOCK})::INT AS place, (pos // {BLOCK}) * period // share AS release,
  ((pos // {BLOCK} + 1) * period + share - 1) // share AS deadline, (pos // {BLOCK}) // share * period + off AS slot
FROM r JOIN u USING (source) JOIN f ON f.source = r.source AND f.k = (pos // {BLOCK}) % share
"""
