"""Near dedup against brute force over all pairs of full sets."""

import random

import pytest
from pyspark.sql import functions as F

from loomrank.llm import common, components, line_dedup
from loomrank.llm.near_dedup import keep_representatives, near_duplicates, op10_near_dedup, shingle_set

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain_set(text, k=5):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, percent):
    sets, up = {}, {}
    for d, t in rows:
        sets[d] = plain_set(t)
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [dice.choice(vocabulary) for _ in range(n)]

    passage = prose(60)
    rows, d = [], 0
    for _ in range(6):
        base = prose(dice.randint(60, 200))
        for _ in range(dice.randint(2, 40)):
            w = list(base)
            for _ in range(dice.randint(0, 4)):
                w[dice.randrange(len(w))] = dice.choice(vocabulary)
            rows.append((d, " ".join(w)))
            d += 1
    for _ in range(60):
        rows.append((d, " ".join(prose(dice.randint(20, 90)) + passage + prose(dice.randint(20, 90)))))
        d += 1
    for n in (0, 1, 3, 4, 5, 6):
        for _ in range(2):
            rows.append((d, " ".join(vocabulary[:n])))
            d += 1
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_components_equal_brute_force(spark, percent, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), percent).collect()}
    assert got == brute(rows, percent)


def test_query_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_near_dedup(spark, sf_dir).collect()}
    assert got == brute(rows, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (None, "a b"), (7, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], SCHEMA + ", id string, comp string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (7, 1, 7)]
    assert near_duplicates(df.limit(0)).collect() == []
    kept = keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 7]


def test_words_are_cut_at_ascii_white_space_only():
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("a b\x1cc d e f")) == 1
    assert (shingle_set("É a b c d") == shingle_set("é a b c d")).all() == False  # noqa: E712
    assert (shingle_set("A B C D E f") == shingle_set("a b c d e\tf")).all()


def test_many_shared_keys_are_not_sent_to_every_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "staged", lambda df, label: (seen.append((label, df._jdf.queryExecution().toString())), common.staged(df, label))[1])
    with common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for n, sent in ((1_000, True), (components.NARROW + 1, False)):
            seen.clear()
            state = spark.range(2 * n).selectExpr("id", "1 as need", f"array(id % {n}) as keys")
            assert components.shrunk(state, "many").count() == 2 * n
            assert [("BroadcastHashJoin" in plan) for label, plan in seen if label == "many-open"] == [sent]


def test_members_of_a_family_that_are_alike_apart_from_its_middle_get_few_links(spark):
    base = list(range(1000, 1100))
    sets = {i: base + [10_000 + i] for i in range(80)}  # near the middle
    sets |= {100 + i: base[12:] + list(range(2000, 2012)) + [20_000 + i] for i in range(60)}  # not linked with it, all with each other
    sets |= {200 + i: base[:60] + list(range(3000, 3200)) + [30_000 + i] for i in range(40)}  # the same, by large differences
    nodes = common.staged(spark.createDataFrame([(i, [7], s) for i, s in sets.items()], "id long, keys array<long>, sketch array<long>"), "test-nodes")
    found = components.links(nodes, [F.col("keys")], F.lit(1), lambda ids: nodes.join(ids, "id", "left_semi").select("id", F.col("sketch").alias("values")), 80, 400, "test", room=70, rounds=1)
    pairs = [tuple(r) for t in found for r in t.collect()]
    like = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
    assert all(like(a, b) for a, b in pairs) and len(pairs) < 4 * len(sets)  # 60 * 59 / 2 and more when all of them met
    comp = {i: i for i in sets}
    for _ in sets:
        comp |= {x: min(comp[a], comp[b]) for a, b in pairs for x in (a, b)}
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: comp[i] for i in sets} == {i: i // 100 * 100 for i in sets}


def test_bands_and_wide_shingles_are_those_of_every_character(spark):
    lines = ["abcdefghij", "short", "größere Straße", "\U0001F600 smile and \u4e2d\u6587 text here", "x" * 40]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.shingles(F.col("line"), every=True).alias("s")).collect()
    for r in rows:
        x = r["line"]
        assert len(r["s"]) == len({x[i : i + 8] for i in range(max(1, len(x) - 7))})


def test_signatures_take_shingles_that_start_with_a_space_first_then_all_others(spark):
    lines = ["abcdefghij", "short", "a b", "one two three four", "größere Straße und noch mehr Wörter", "\U0001F600 smile and \u4e2d\u6587 text here", "\u4e2d\u6587" * 30, "ab " * 300, " ".join(f"word{i}" for i in range(40))]
    for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.signature(F.col("line")).alias("s")).collect():
        sets = {r["line"][i : i + 8] for i in range(max(1, len(r["line"]) - 7))}
        spaced = sum(x[0] == " " for x in sets)
        assert len(set(r["s"])) == len(r["s"]) == min(10, len(sets)) and r["s"] == sorted(r["s"])
        assert sum(x < 0 for x in r["s"]) == min(10, spaced)
    two = [r["s"] for r in spark.createDataFrame([("head of it " + lines[-1],), (lines[-1] + " and a tail",)], "line string").select(line_dedup.signature(F.col("line")).alias("s")).collect()]
    assert len({*two[0]} & {*two[1]}) >= 6


def test_a_filter_of_keys_keeps_theirs_and_few_others(spark):
    keys = common.staged(spark.range(0, 50_000).select((F.col("id") * 7 - 100_000).alias("key")), "test-keys")
    rows = spark.range(0, 350_000).select((F.col("id") - 100_000).alias("key"))
    left, bits = components.sifted(rows, keys, "test")
    assert left.join(keys, "key").count() == 50_000 and left.count() < 51_000 and bits.count() <= components.GROUPS


def test_open_nodes_are_the_same_with_the_filter(spark, monkeypatch):
    nodes = common.staged(spark.createDataFrame([(i, 2, [i // 2, 10_000 + i, 20_000 + i // 3 if i % 5 else -i]) for i in range(600)], "id long, need int, keys array<long>"), "test-open")
    got = []
    for narrow in (components.NARROW, 10):
        monkeypatch.setattr(components, "NARROW", narrow)
        got.append(sorted((r["id"], r["need"], sorted(r["keys"])) for r in components.shrunk(nodes, "test").collect()))
    assert got[0] == got[1] and len(got[0]) > 400


def test_sets_are_unpacked_once_for_each_side_of_a_pair(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "staged", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.staged(df, label))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    values = spark.createDataFrame([(1, "a line of some words"), (2, "a line of some words!"), (3, "other")], "id long, values string")
    out = components.alike(pairs, values, 80, "test", lambda line: line_dedup.shingles(line, every=True))
    assert [tuple(r) for r in out.collect()] == [(1, 2)] and plans[0].count("xxhash64(") == 2


def test_close_equals_the_estimate_by_hand(spark):
    dice = random.Random(5)
    rows = [(sorted(dice.sample(range(40), dice.randint(1, 10))), sorted(dice.sample(range(40), dice.randint(1, 10)))) for _ in range(300)]
    rows += [(x, sorted({*x[1:], dice.randrange(40)})) for x, _ in rows]
    for r in spark.createDataFrame(rows, "x array<int>, y array<int>").select("x", "y", components.close("x", "y", 10, 50).alias("close")).collect():
        low = sorted({*r["x"]} | {*r["y"]})[:10]
        assert r["close"] == (100 * len({*low} & {*r["x"]} & {*r["y"]}) >= 50 * len(low))


def test_signatures_of_equal_lines_are_not_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "staged", lambda df, label: plans.append((label, df._jdf.queryExecution().toString())) or common.staged(df, label))
    docs = spark.createDataFrame([(i, f"line {i // 2} of some words\nand one that all have") for i in range(40)], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]): (r["keep_doc_id"], r["keep_pos"]) for r in line_dedup.line_classes(docs, 95, every=True).collect()}
    assert got == {(i, p): ((0, 1) if p else (i // 2 * 2, 0)) for i in range(40) for p in (0, 1)}
    assert any(label == "line-distinct" for label, _ in plans)
    assert not any("s0" in line for label, plan in plans if label in ("line-copies", "line-distinct") for line in plan.split("\n") if "Exchange hashpartitioning" in line) and all("Exchange hashpartitioning" not in plan for label, plan in plans if label == "line-distinct")


def test_first_copies_are_the_same_with_the_filter(spark, monkeypatch):
    at = common.staged(spark.range(3000).selectExpr("id", "id % 700 as h1", "id % 1400 as h2"), "test-at")
    copies = common.staged(at.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 2").select("h1", "h2", "first"), "test-copies")
    got = []
    for few in (True, False):
        monkeypatch.setattr(line_dedup, "small", lambda keys, few=few: few)
        rows, _ = line_dedup.with_first(at, copies, "test")
        got.append(sorted((r["id"], -1 if r["first"] is None else r["first"]) for r in rows.collect()))
    assert got[0] == got[1] and len(got[0]) == 3000 and len({x[1] for x in got[0]}) == 201
