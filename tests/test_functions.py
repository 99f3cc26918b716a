"""Hand-computable cases of functions and operators."""

import pytest
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import text as X
from loomrank.functions import vocab as V
from loomrank.llm.common import setting
from loomrank.operators import chunking, evaluate, evidence, search, store


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("v")).first()["v"]


def test_clean_and_numbers(spark):
    assert one(spark, X.clean_text(F.lit(" C++ & C#,  node.js\n3.72 "))) == "c++ c# node.js 3.72"
    assert one(spark, X.fix_numbers(F.lit("gpa 3 72 of 4 00 and 9 00 and 5 72"))) == "gpa 3.72 of 4.00 and 9.00 and 5 72"
    assert one(spark, X.clean_text_ascii(F.lit("Élan 3.72!"))) == "lan 3 72"


def test_years(spark):
    assert one(spark, X.experience_years(F.lit("3 years experience, 5+ yrs of experience"))) == 5
    assert one(spark, X.experience_years(F.lit("none"))) == 0
    assert one(spark, X.any_years(F.lit("1.5 years and 2 yrs"))) == 2.0
    assert one(spark, X.grade(F.lit("scored 8.5 10"))) == 0.85


def test_degrees(spark):
    degrees = ["BTech", "M.Tech", "PhD", "", "diploma"]
    assert [one(spark, X.normal_degree(F.lit(d))) for d in degrees] == ["bachelor", "master", "doctorate", "", "diploma"]
    assert one(spark, S.education(F.array(F.lit("b.tech")), F.array(F.lit("bachelor of arts")))) == 1.0
    assert one(spark, S.education(F.array(F.lit("phd")), F.array(F.lit("diploma")))) == 0.0


@pytest.mark.parametrize("jd,own,want", [(0, 0, 0.5), (0, 2, 1.0), (4, 2, 0.5), (4, 8, 1.0), (3, 1, 0.333)])
def test_experience(spark, jd, own, want):
    assert one(spark, S.experience(F.lit(float(jd)), F.lit(float(own)))) == want


def test_capped_experience_keeps_its_bonus(spark):
    assert one(spark, S.experience_capped(F.lit(4.0), F.lit(8.0))) == 1.1


def test_names(spark):
    assert one(spark, X.name_from_file(F.lit("/a/MT2023123_ana_silva_Resume(2).pdf"))) == "Ana Silva"
    assert one(spark, X.name_from_text(F.lit("Ana Petrova Silva\nSummary"))) == "Ana Petrova Silva"
    assert one(spark, X.name_from_text(F.lit("1 2 jo.bloggs@example.org"))) == "Jo Bloggs"
    assert one(spark, X.name_from_text(F.lit(""))) is None


def test_first_words_keep_letters_without_a_capital(spark):
    """Small letters of the words are those of the SQL, for every letter and sigma at a word's end."""
    import duckdb

    from loomrank.plans import catalog

    assert one(spark, X.first_words(F.lit(" ana  SILVA x"))) == "Ana Silva" and one(spark, X.first_words(F.lit("eau ßlich"))) == "Eau ßlich"
    odd = [chr(i) for i in range(0xA1, 0x1E944) if chr(i).isalpha() and (chr(i).lower() != chr(i) or chr(i).upper() != chr(i) or chr(i).title() != chr(i))]
    texts = ["", " ", "ΑΒΣ ΟΔΟΣ", "a", "ab ﬁx y"] + [t for c in odd for t in (f"{c}ab x{c} z", f"x {c}", c)]
    want = duckdb.sql("WITH documents AS (SELECT unnest($t) AS text, generate_subscripts($t, 1) AS doc_id) SELECT value FROM (" + catalog.ORACLES["first_words"] + ") ORDER BY doc_id", params={"t": texts}).fetchall()
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.lower(X.first_words(F.col("text"))).alias("v")).collect()
    assert [(texts[r["i"]], r["v"], want[r["i"]][0]) for r in got if r["v"] != want[r["i"]][0]] == []


def test_dedupe(spark):
    assert one(spark, X.deduped(F.array(*[F.lit(s) for s in ["SQL", " sql ", "", "Go"]]))) == ["SQL", "Go"]


def test_rrf_puts_the_shared_document_first(spark):
    r = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "q int, l int, chunk_id string, rank int")
    got = search.rrf(r, ["q"], "chunk_id").orderBy(F.desc("fused_score")).collect()
    assert got[0]["chunk_id"] == "b" and abs(got[0]["fused_score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_verdict_arithmetic(spark):
    reqs = spark.createDataFrame([("a", "required"), ("b", "preferred")], "skill_name string, tier string")
    v = spark.createDataFrame([(1, "a", "claimed_only", 0), (1, "a", "demonstrated", 1), (1, "b", "absent", 0)], "candidate_id int, skill_name string, verdict string, seq int")
    got = evidence.aggregate_verdicts(reqs, v, spark.createDataFrame([(1,), (2,)], "candidate_id int")).orderBy("candidate_id").collect()
    assert abs(got[0]["evidence"] - 0.75) < 1e-12 and abs(got[0]["required_skills"] - 0.75) < 1e-12
    assert got[1]["evidence"] == 0.0


def test_citations(spark):
    spans = spark.createDataFrame([(1, "x:1", "Built  Pipelines in Go")], "candidate_id int, chunk_id string, text string")
    rows = [(0, 1, "demonstrated", ["x:1"], "built pipelines"), (1, 1, "demonstrated", ["x:9"], None), (2, 1, "demonstrated", ["x:1"], "made pipelines"), (3, 1, "absent", [], "q"), (4, 1, "absent", [], None)]
    p = spark.createDataFrame(rows, "k int, candidate_id int, verdict string, cited_chunk_ids array<string>, quote string")
    got = {r["k"]: (r["verdict"], r["rejected"]) for r in evidence.validate_citations(p, spans, ["k"]).collect()}
    assert got == {0: ("demonstrated", False), 1: ("claimed_only", True), 2: ("claimed_only", True), 3: ("claimed_only", True), 4: ("absent", False)}


def test_unwrap(spark):
    raws = ['```json\n[{"skill_name": "a"}]\n```', '{"x": [], "y": [{"skill_name": "b"}]}', "junk"]
    got = [one(spark, F.transform(evidence.unwrapped(F.lit(r)), lambda v: v["skill_name"])) for r in raws]
    assert got == [["a"], ["b"], None]


def test_store(spark):
    points = spark.createDataFrame([(i, [float(i)] * 2, i % 3) for i in range(10)], "id int, vector array<double>, label int")
    new = points.withColumn("label", F.lit(9)).withColumn("seq", F.lit(1))
    twice = store.upserted(store.upserted(points, new, 2), new, 2)
    assert twice.count() == 10 and twice.where("label = 9").count() == 10
    with pytest.raises(Exception, match="must have 3 values"):
        store.upserted(points, new, 3).collect()
    assert store.deleted(points, {"label": [0, 1]}).count() == 3
    assert points.where(store.matches({})).count() == 10


def test_kendall(spark):
    p = spark.createDataFrame([(0, i, i, i) for i in range(4)] + [(1, i, i, -i) for i in range(4)] + [(2, 0, 1, 1)], "g int, item int, a int, b int")
    assert {r["g"]: r["tau"] for r in evaluate.kendall_tau(p, ["g"]).collect()} == {0: 1.0, 1: -1.0, 2: 0.0}


def test_rank_ties_and_buckets(spark):
    from loomrank.operators.ranking import ranked

    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, 0.50001)], "id int, s double")
    assert [r["id"] for r in ranked(df, "s", "id").orderBy("rank").collect()] == [2, 4, 1, 3]


TEXT = "Ana Silva\nSummary line one. Two here! Three?\nTechnical Skills\npython, sql\nProjects\n- first thing built Jan 2023 - Mar 2024\n- second thing\n1. third\nEducation\nMSc\n" + "word " * 300


def test_chunk_invariants():
    got = chunking.chunk_ranges(TEXT)
    assert {s for s, _, _ in got} >= {"skills", "projects", "education"}
    for _, a, b in got:
        assert 0 <= a < b <= len(TEXT) and len(TEXT[a:b].split()) <= 120 and TEXT[a:b] == TEXT[a:b].strip()
    ranges = chunking.section_ranges("- first Jan 2023 - Mar 2024\n- second\n1. third", 0, 46, "projects")
    assert len(ranges) == 3
    assert chunking.chunk_ranges("") == []


def test_page_lines_by_brute_force(spark):
    """Random pages (ties, near heights, one and two columns, a page over many batches) against a word-by-word loop and the column operator."""
    import random

    from loomrank.operators.sections import column_split

    rng = random.Random(5)
    words = []
    for doc in (None, *range(25)):
        for page in range(rng.randint(1, 3)):
            two = rng.random() < 0.6
            for i in range(rng.choice([1, 2] if doc is None else [1, 2, 40, 90, 300])):
                x = (320.0 if two and rng.random() < 0.5 else 20.0) + rng.randrange(8) * 12.0
                words.append((doc, page, i, f"w{i}", x, rng.choice([0.0, 2.5, 14.0, 1.5, 15.75, 28.0]) + rng.randrange(4) * 40, rng.choice([9.0, 10.0, 11.5, 30.0])))
    df = spark.createDataFrame(words, "doc_id long, page int, i long, text string, x0 double, doctop double, height double")
    split = {(r["doc_id"], r["page"]): r["split"] for r in column_split(df, ["doc_id", "page"]).collect()}
    want = []
    for key in {w[:2] for w in words}:
        mine = [(int(split.get(key) is not None and x > split[key]), top, x, i, t, h) for d, p, i, t, x, top, h in words if (d, p) == key]
        body = sorted(w[5] for w in mine if w[5] < 20)
        lines, mean, n, col = [], None, 0, None
        for c, top, _, _, t, _ in sorted(mine):
            if mean is not None and c == col and abs(top - mean) <= V.LINE_TOLERANCE:
                lines[-1][1].append(t)
                mean, n = (mean * n + top) / (n + 1), n + 1
            else:
                lines.append((c, [t]))
                mean, n, col = top, 1, c
        want += [(*key, c, i, " ".join(t), body[len(body) // 2] if body else 10.0) for i, (c, t) in enumerate(lines)]
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "70"):
        got = [tuple(r) for r in chunking.page_lines(df).collect()]
    assert any(split.values()) and sorted(got, key=repr) == sorted(want, key=repr)
    assert chunking.page_lines(df.limit(0)).count() == 0


def test_evaluation_of_retrieval_reads_the_texts_in_one_exchange(spark, sf_dir):
    """Recall by config equals that of separate runs, and the texts are dealt once, however often the chunks are used."""
    from loomrank.plans import match_queries as M

    c, q = M.chunks(spark, sf_dir), M.req_strings(spark)
    gold = {(r["query_id"], r["candidate_id"], r["chunk_id"]) for r in M.gold_chunks(c).collect()}
    both = search.hybrid(c, q)
    first = q.where("pos = 0").select("query_id", F.col("text").alias("query"))
    apart = {"dense_only": search.hybrid(c, q, 3, ("dense",)), "bm25_only": search.hybrid(c, q, 3, ("lexical",)), "hybrid": both.where("rank <= 3"), "hybrid_ce": search.rerank(both.join(first, "query_id"), "query", ["query_id", "candidate_id"], floor=None)}
    want = {k: len(gold & {(r["query_id"], r["candidate_id"], r["chunk_id"]) for r in df.select("query_id", "candidate_id", "chunk_id").collect()}) for k, df in apart.items()}
    df = M.eval_ablation(spark, sf_dir)
    assert {r["config"]: (r["hits"], r["pairs"]) for r in df.collect()} == {k: (v, len(gold)) for k, v in want.items()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Exchange hashpartitioning(doc_id") - final.count("ReusedExchange") <= 1 and "hashpartitioning(doc_id" in final


def test_bm25_mean_only_where_a_token_is_common(spark):
    """A token in over half of a corpus's chunks has a quarter of the mean over all its tokens, with the words looked up or joined."""
    import math

    c = spark.createDataFrame([(1, "a", "sql x"), (1, "b", "sql y y"), (1, "c", "sql go"), (2, "d", "go"), (2, "e", "z"), (2, "f", "w")], "candidate_id int, chunk_id string, text string")
    q = spark.createDataFrame([(0, "sql go")], "query_id int, text string")
    got = {r["chunk_id"]: r["score"] for r in search.bm25(c, q, ["candidate_id"]).collect()}
    raw = {1: math.log(2.5 / 1.5), 3: math.log(0.5 / 3.5)}
    mean = (3 * raw[1] + raw[3]) / 4

    def part(size, avg):
        return 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / avg))

    assert set(got) == {"d", "c"} | ({"a", "b"} if mean > 0 else set())
    assert abs(got["c"] - (raw[1] + 0.25 * mean) * part(2, 7 / 3)) < 1e-12 and abs(got["d"] - raw[1] * part(1, 1)) < 1e-12


def test_streaming_dedupes(spark, tmp_path):
    from loomrank.streaming.ingest import ingest_available

    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = ingest_available(spark, str(tmp_path / "documents.parquet"))
    assert got.count() == 3 and {r["status"] for r in got.collect()} == {"done"}


def test_docx(spark, tmp_path):
    import zipfile

    from loomrank.sources.files import read_documents

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "One\nTwo" and got["b.docx"]["error"] and got["c.txt"]["text"] == ""
