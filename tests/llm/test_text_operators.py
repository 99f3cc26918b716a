"""Substring dedup, quality, line dedup, decontamination and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomrank.llm import decontamination, line_dedup, quality_classifier, substring_dedup

SCHEMA = "doc_id long, text string"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu".split() for b in "rin tol mek sap dun vil cor neth lash bim".split()]


def prose(dice, sentences):
    return " ".join(" ".join(dice.choice(WORDS) for _ in range(dice.randint(5, 12))).capitalize() + "." for _ in range(sentences))


# --- substring dedup ---
def brute_removals(rows, span, words):
    """Spans by a plain dictionary over all rows in order; {doc: (sentences that go, sentences that stay as the first)}."""
    first, repeated, seen = {}, set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = [p for p in re.findall(r"[^\n]*?(?:[.!?]+(?=\s)|[。！？]+|(?=\n)|$(?![\s\S]))\s*", text or "") if p]
        flat = [" ".join(p.lower().split()) for p in parts]
        count = [max(len(f.split()), len(f) // 12) for f in flat]
        for i in range(len(flat)):
            j = i + span
            while j <= len(flat) and sum(count[i:j]) < words:
                j += 1
            if j <= len(flat):
                key = tuple(flat[i:j])
                if key in first:
                    repeated.add(key)
                seen.append((doc, i, j, key, first.setdefault(key, (doc, i))))
    gone, kept = defaultdict(set), defaultdict(set)
    for doc, i, j, key, at in seen:
        if key in repeated:
            (kept if at == (doc, i) else gone)[doc].update(range(i, j))
    return {d: (gone[d], kept[d] - gone[d]) for d in {*gone, *kept}}


def found_removals(df):
    found = defaultdict(lambda: (set(), set()))
    for r in substring_dedup.removals(df).collect():
        found[r["doc_id"]][r["kept"]].update(range(r["first_sentence"], r["last_sentence"] + 1))
    return dict(found)


def test_repeated_passages_go_and_the_first_stays(spark):
    dice = random.Random(4)
    passage, short = prose(dice, 8), prose(dice, 1)
    rows = [(i, "\n".join([prose(dice, 4), passage if i % 3 == 0 else short, prose(dice, 4)])) for i in range(30)] + [(40, passage), (41, None), (42, ""), (43, "One."), (44, "word " * 60_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", row int")
    assert found_removals(df) == brute_removals(rows[:-1], substring_dedup.SPAN, substring_dedup.WORDS)
    got = substring_dedup.removals(df).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {i for i in range(3, 30, 3)} | {40} and {r["doc_id"] for r in got if r["kept"]} == {0}
    texts = dict(rows)
    assert all(passage.startswith(texts[r["doc_id"]][r["char_start"] : r["char_end"]].strip()) and r["first_doc_ids"] == [0] for r in got if not r["kept"])
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(df).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1] and clean[41] is None and clean[40] == ""
    assert clean[3] == texts[3].replace(passage, "").replace("\n\n", "\n") and substring_dedup.substring_dedup(df).columns == df.columns
    assert substring_dedup.removals(df.limit(0)).collect() == []


def test_sentences_are_the_whole_text():
    for t in ["", "a", "A b. C d!\n\ne f? g", "\n\nx. ", "no end\nline two.", "...", "a.b c.\td", "今天。明天！后天"]:
        assert "".join(substring_dedup.sentences(t)) == t
    assert len(substring_dedup.sentences("今天。明天！后天")) == 3


def test_copies_of_one_row_are_one_document(spark):
    dice = random.Random(1)
    t = prose(dice, 9)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], SCHEMA)
    assert sorted((r["doc_id"] or 0) for r in substring_dedup.removals(df).where("not kept").collect()) == [0, 2]


def test_passages_of_over_50_words_inside_sentences_are_found(spark):
    dice = random.Random(51)
    rows, passages = [], {}
    for i in range(100):
        words, start = prose(dice, 20).split(), dice.randint(1, 10)
        passages[i] = words[start : start + dice.randint(51, 60)]
        for d in (i, 100 + i):
            own = prose(dice, 8).split()
            rows.append((d, " ".join(own[:18] + passages[i] + own[18:])))
    gone, texts = defaultdict(int), dict(rows)
    got = substring_dedup.removals(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        assert " ".join(texts[r["doc_id"]][r["char_start"] : r["char_end"]].split()) in " ".join(passages[r["doc_id"] % 100])
        gone[r["doc_id"]] += 0 if r["kept"] else r["n_words"]
    assert sum(2 * gone[100 + i] > len(passages[i]) for i in passages) >= 95 and {r["doc_id"] for r in got} >= {d for d in range(100) if gone[100 + d]}


def test_recall_of_repeated_runs_of_50_words_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    holders = defaultdict(set)
    for d, w in rows:
        for i in range(len(w) - 49):
            holders[hash(tuple(w[i : i + 50]))].add(d)
    want = set().union(*(x for x in holders.values() if len(x) > 1))
    got = {r["doc_id"] for r in substring_dedup.op1_substring_dedup(spark, sf).collect()}
    assert len(want) > 50 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * (len(rows) - len(want))


# --- quality ---
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_classifier.op2_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(got[d]["held_out"] == quality_classifier.is_held_out(d) for d in got)
    out = [(labels[d], got[d]["predicted"]) for d in labels if got[d]["held_out"]]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    bad = [r["score"] for d, r in got.items() if labels.get(d) == 0]
    good = [r["score"] for d, r in got.items() if labels.get(d) == 1]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(i, f"plain words here number {i}" if i % 2 else "!!! ### $$$ |||" * (i + 1), 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (None, "x", 1)], SCHEMA + ", score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, text int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.quality(df, labels).collect()}
    assert len(got) == 63 and got[100] == got[101] and got[1] > 0.5 > got[0]
    assert quality_classifier.quality(df, labels.limit(0)).count() == 63
    assert quality_classifier.quality(df.limit(0), labels).collect() == []
    kept = quality_classifier.keep_good(df, labels)
    assert kept.columns == df.columns and {1, 3, 59} <= {r["doc_id"] for r in kept.collect()}


def test_labels_of_held_out_rows_are_not_read(spark):
    df = spark.createDataFrame([(i, "good words" if i % 2 else "### $$$") for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, (i + quality_classifier.is_held_out(i)) % 2) for i in range(60)], "doc_id long, quality int")
    a, b = ({r["doc_id"]: r["score"] for r in quality_classifier.quality(df, x).collect()} for x in (labels, other))
    assert a == b


def test_the_ranker_learns_from_all_labelled_rows(spark):
    ids = [i for i in range(30_000) if not quality_classifier.is_held_out(i)]
    assert len(ids) > 15_000
    # the 6,000 rows with the smallest hash of the id show other texts than the rest
    first = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").limit(6_000).collect()}
    rows = [(i, ("plain words" if i % 2 else "### $$$") if i in first else ("other text 77" if i % 2 else "@@@ 12345 %%%")) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = quality_classifier.quality(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.99
    # labels that are 0 for 40 rows only, none of them among the 6,000
    few = set([i for i in ids if i not in first][:40])
    rows = [(i, "### $$$ %%%" if i in few else "plain words here") for i in ids]
    got = quality_classifier.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i not in few)) for i in ids], "doc_id long, quality int")).collect()
    assert all(r["predicted"] == (r["doc_id"] not in few) for r in got)


# --- lines ---
def plain_shingles(line, width=line_dedup.WIDTH):
    """All character shingles of a line, at every offset."""
    line = re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip()
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def chosen_shingles(line, width=line_dedup.WIDTH):
    """Those at the start of each run without spaces, and inside it wherever ``width`` more characters of the run follow."""
    line, out = re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(), set()
    for m in re.finditer(r"[^ ]+", line):
        out |= {line[i : i + width] for i in range(m.start(), max(m.start() + 1, m.end() - width + 1))}
    return out


def classes(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def pairs_together(of):
    groups = defaultdict(list)
    for i, c in of.items():
        groups[c].append(i)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_lines_equal_brute_force(spark):
    dice = random.Random(9)
    base = [" ".join(dice.choice(WORDS) for _ in range(dice.randint(8, 60))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(dice.randint(1, 6)):
            w = dice.choice(base).split()
            for _ in range(dice.randint(0, 2)):
                w[dice.randrange(len(w))] = dice.choice(WORDS)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines + ["", "short", "----"])))
    df = spark.createDataFrame(rows, SCHEMA)
    at = [(d, i, line) for d, t in rows for i, line in enumerate(t.split("\n")) if line]
    got = {(r["doc_id"], r["pos"]): (r["keep_doc_id"], r["keep_pos"]) for r in line_dedup.line_classes(df).collect()}
    assert set(got) == {x[:2] for x in at}
    exact = pairs_together({x[:2]: c for x, c in zip(at, classes([chosen_shingles(x[2]) for x in at]))})
    plain = pairs_together({x[:2]: c for x, c in zip(at, classes([plain_shingles(x[2]) for x in at]))})
    mine = pairs_together(got)
    assert mine <= exact and len(mine & exact) >= 0.97 * len(exact)
    assert len(mine & plain) >= 0.9 * len(plain) and len(mine & plain) >= 0.9 * len(mine)
    clean = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    for d, t in rows:
        assert clean[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if got.get((d, i), (d, i)) == (d, i))


def test_lines_odd_rows(spark):
    long = "a line of words that is long enough to count here"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "\n\n" + long.upper() + "  \nkeep"), (5, "é" * 30), (6, "-" * 40), (7, "-" * 40), (8, "keep\nx"), (9, "word " * 60_000), (3, "other text of the same id")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", row int, drop int")
    clean = [(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(df).collect()]
    want = [(1, None), (2, ""), (3, long), (3, long), (None, ""), (4, "\n\nkeep"), (5, "é" * 30), (6, "-" * 40), (7, ""), (8, "x"), (9, "word " * 60_000), (3, "other text of the same id")]
    assert sorted(clean, key=str) == sorted(want, key=str)
    assert line_dedup.line_dedup(df).columns == df.columns and line_dedup.line_dedup(df.limit(0)).collect() == []


def test_lines_of_a_large_family(spark):
    dice = random.Random(90)
    template = [dice.choice(WORDS) + dice.choice(WORDS) for _ in range(90)]
    lines = [" ".join(template)]
    for _ in range(600):
        w = list(template)
        for i in dice.sample(range(90), 3):
            w[i] = dice.choice(WORDS) + dice.choice(WORDS)
        lines.append(" ".join(w))
    near = {i for i, s in enumerate(map(chosen_shingles, lines)) if 100 * len(s & chosen_shingles(lines[0])) >= 80 * len(s | chosen_shingles(lines[0]))}
    got = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), SCHEMA)).collect()
    assert len(near) > 500 and {r["doc_id"] for r in got if r["keep_doc_id"] == 0} >= near


def test_lines_of_one_long_run_are_read_to_the_end(spark):
    head, a, b = "机器学习模型需要大量的数据", "才能得到好的结果因此清洗很重要也很费时间", "可是今天我们去海边散步看见许多白色的鸟儿"
    digest = "".join(random.Random(1).choices("0123456789abcde", k=160))
    rows = [(1, head + a), (2, head + b), (3, digest), (4, "f" + digest[1:]), (5, digest[:80] + digest[:79:-1]), (6, "the Donaudampfschifffahrtsgesellschaft"), (7, "the Donaudampfschifffahrtskapitänsmütze")]
    got = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_lines_are_compared_by_shingles_at_every_character(spark, tmp_path):
    dice = random.Random(31)
    base = [" ".join(dice.choice(WORDS) for _ in range(dice.randint(6, 60))) for _ in range(30)]
    lines = ["short", "SHORT", "hi", "word " * 300, "word " * 290 + "other", "机器学习模型需要大量的数据才能得到好的结果", "机器学习模型需要大量的数据才能得到好的结果。"]
    for _ in range(400):
        w = dice.choice(base).split()
        for _ in range(dice.randint(0, 3)):
            w[dice.randrange(len(w))] = dice.choice(WORDS)
        lines.append(" ".join(w))
    spark.createDataFrame(list(enumerate(lines)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    plain = pairs_together(dict(enumerate(classes([plain_shingles(x) for x in lines]))))
    query = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert set(query) == set(range(len(lines)))
    mine = pairs_together(query)
    assert mine <= plain and len(mine) >= 0.97 * len(plain)
    out = corpus_pipeline.lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r["doc_id"] for r in out.where("text <> ''").collect()} == {d for d, k in query.items() if d == k}


# --- decontamination ---
ITEMS = [(1, "If Anna has 12 apples and gives 5 apples to Bob then how many apples does Anna have left over"), (2, "the quick brown fox jumps over the lazy dog tonight"), (3, "too short"), (4, None), (5, "only six words are in here")]


def holds(spark, text):
    df = spark.createDataFrame([(7, text, 0)], SCHEMA + ", window int")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, doc_id int")
    return {r["item_id"]: (r["n_windows"], r["exact_windows"]) for r in decontamination.contaminated(df, items).collect()}


def test_items_are_found_also_with_other_values(spark):
    item = ITEMS[0][1]
    got = holds(spark, "some text before. " + item + " and after")
    assert set(got) == {1} and got[1][0] == got[1][1] > 5
    other = item.replace("Anna", "Mary").replace("Bob", "Tom").replace("12", "31").replace("5", "8")
    got = holds(spark, "before that. " + other)
    assert set(got) == {1} and got[1][1] < got[1][0]
    assert holds(spark, "x. and only six words are in here, really") == {5: (1, 1)}
    assert holds(spark, "too short") == {} and holds(spark, None) == {} and holds(spark, "") == {}


def test_items_of_few_plain_words_and_after_headings_are_found(spark):
    texts = ["Who wrote Pride and Prejudice?", "Where is Mount Kilimanjaro?", "Janet’s ducks lay many eggs daily", "Compute 3 + 4 * 12 - 5 = 7", "New York Los Angeles San Francisco Las Vegas Salt Lake City"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(10 * i + j, form % t) for i, t in enumerate(texts) for j, form in enumerate(["%s", "see this. %s Then on", "Question: %s", "A heading\n%s\nnext"])] + [(99, "Who wrote Sense and Sensibility? Where is Mount Everest now - - - -")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()}
    assert got == {(10 * i + j, i) for i in range(len(texts)) for j in range(4)}


def test_inconsistent_slots_do_not_match(spark):
    item = "If we take 12 of these and add 12 of those what then"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")

    def found(t):
        return decontamination.contaminated(spark.createDataFrame([(1, t)], SCHEMA), items).collect()

    windows = {r["n_windows"] for r in found(item.replace("12", "30"))}
    assert windows and max(windows) > 4
    mixed = found("If we take 12 of these and add 30 of those what then")
    assert (mixed[0]["n_windows"] if mixed else 0) < max(windows)


def test_all_benchmark_leaks_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if " ".join(x.split()) in " ".join((t or "").split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op7_decontamination(spark, sf_dir).collect()}
    assert want <= got and len(got) <= len(want) + 1
    kept = decontamination.keep_clean(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontamination.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0)).collect() == []


def test_a_full_filter_gives_the_same(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.where("doc_id < 60")
    want = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    assert want and sorted(map(tuple, decontamination.contaminated(docs, items, bits=64).collect())) == want


# --- pipeline ---
def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns, before = [], docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before and now
        names.append((name, len(now)))
        before = now
    assert names[0][1] < 200 and names[3][1] == names[4][1]
    assert docs.count() == corpus_pipeline.run(spark, sf_dir).count()


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "decontamination", "mixing"])
def test_stages_take_empty_tables(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).collect() == []
