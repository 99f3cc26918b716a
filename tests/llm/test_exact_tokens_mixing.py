"""Exact dedup, token counts and mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import same, views

from loomrank.llm import exact_dedup, mixing
from loomrank.llm.token_counts import merger, model_file, op8_token_counts, token_counts

SCHEMA = "doc_id long, text string"


def test_exact_query_equals_sql(spark, sf_dir):
    assert same(exact_dedup.op6_exact_dedup(spark, sf_dir), views(sf_dir).execute(exact_dedup.ORACLE)) > 0


def test_exact_odd_rows(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (1, "a\tb"), (6, "a\x1cb"), (7, "x" * 200_000), (8, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA + ", keep_id int, run string").repartition(7)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, fan_in=2).collect()}
    assert got == {(3, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 2, True), (8, 7, 2, False)}
    digest = exact_dedup.exact_dedup(df).where("doc_id = 3").first()["text_sha256"]
    assert digest == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


def library(texts):
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model_file()).encode(texts, num_threads=1)]


def test_counts_equal_the_library_on_odd_texts():
    dice = random.Random(5)
    signs = "abcdeABC  \t\n\n.,!0123▁éüßñ漢字😀 ​<s></s>"
    texts = ["".join(dice.choice(signs) for _ in range(dice.randint(0, 120))) for _ in range(1500)]
    texts += ["", " ", "  ", "\n", "<s>", "</s> <unk> <0x0A>", "a" * 3000, "the" * 700, "▁▁a ▁", "▁ ▁", "x\r\ny", "ｆｕｌｌ ①", "é", "\U0001f469‍\U0001f680" * 5]
    m = merger(model_file())
    assert [m.count(t) for t in texts] == library(texts)


def test_counts_of_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    for r in op8_token_counts(spark, sf_dir).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want[r["doc_id"]], len(texts[r["doc_id"]].encode()), want[r["doc_id"]] > 4096)


def test_counts_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (1, "a b", 0)], SCHEMA + ", n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts(df).collect())
    assert got == [(0, 3, 2), (1, 0, 0), (1, 3, 2), (2, 0, 0)]
    assert token_counts(df.limit(0)).collect() == []


def test_mixing_query_equals_sql(spark, sf_dir):
    assert same(mixing.op5_mixing(spark, sf_dir), views(sf_dir).execute(mixing.ORACLE)) > 0


@pytest.mark.parametrize("units", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 999}, {"a": 334, "b": 333, "c": 333}, {"x": 1}])
def test_schedule_stays_within_a_block(units):
    period, done = sum(units.values()), Counter()
    for t, (s, k, slot) in enumerate(mixing.schedule(units)):
        assert slot == t and k == done[s]
        assert k * period // units[s] <= t < -(-(k + 1) * period // units[s])
        done[s] += 1
        for x, u in units.items():
            assert abs(done[x] * period - (t + 1) * u) < period
    assert done == Counter(units)


WEIGHTS = {"a": 0.5005, "b": 0.3003, "c": 0.1992, "none": 0}


def test_given_weights_are_met_over_many_periods():
    units = mixing.shares(dict.fromkeys([*WEIGHTS, "unnamed"], 9), WEIGHTS)
    period, plan, done = sum(units.values()), mixing.schedule(units), Counter()
    assert period <= 10_000 and units["none"] == units["unnamed"] == 0
    for t in range(100 * period):
        done[plan[t % period][0]] += 1
        for s, w in WEIGHTS.items():
            assert abs(done[s] - (t + 1) * w) < 1 - 1e-9


def test_given_weights_edges():
    assert mixing.shares({"a": 1, "b": 1}, {"a": 1e-9, "b": 1}) == {"a": 1, "b": mixing.SLOTS - 1}
    assert mixing.shares({"a": 1, "b": 1}, {"a": 1, "b": 2, "other": 5}) == {"a": 1, "b": 2}
    assert mixing.shares({}, {"a": 1}) == {}
    for bad in ({"a": -1, "b": 2}, {"a": 0}, {}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.shares({"a": 1}, bad)


def test_mixing_by_given_weights(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 4 else "none") for i in range(400)], "doc_id long, source string")
    got = mixing.mixed(df, WEIGHTS, block=2).collect()
    assert len(got) == 400 and len({r["doc_id"] for r in got}) == 400
    placed = [r for r in got if r["source"] != "none"]
    assert all(r["slot"] is None and r["deadline"] is None for r in got if r["source"] == "none")
    assert len({(r["slot"], r["place"]) for r in placed}) == 300 and all(r["release"] <= r["slot"] < r["deadline"] for r in placed)


def test_mixing_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, "hot"), (7, None), (7, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, slot int")
    got = mixing.mixed(df, block=4, period=20, buckets=16).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((d, s or "") for d, s in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    blocks = defaultdict(list)
    for r in got:
        blocks[r["source"]].append((r["slot"], r["place"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert mixing.mixed(df.limit(0)).collect() == []


def test_white_space_rule():
    assert re.sub(exact_dedup.WHITE, " ", "a \t\r\n\x0b\x0cb c") == "a b c"
