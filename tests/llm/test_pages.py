"""HTML extraction and WARC archives."""

import base64
import gzip
import hashlib
import io
import random
import time

import pytest

from loomrank.llm import warc
from loomrank.llm.html_extraction import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a> tagline</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div><div class="sidebar"><p>Side words of some length here</p></div>
<article><h1>Head &amp; line</h1><p><b>First   para&nbsp;one.<br><p>Second <i>para</i>&#33; with &lt;b&gt;.</p><ul><li>item one<li>item two</ul><div class="ad">Buy now</div><form><p>Your name</p><input></form><p>Last.</p></article>
<div id="comments"><p>A reader says a lot of things in this long comment</p></div><footer>&copy; me</footer></body></html>"""


def test_the_article_without_the_rest():
    assert main_text(PAGE) == "Head & line\n\nFirst para one.\n\nSecond para! with <b>.\n\nitem one\n\nitem two\n\nLast."


@pytest.mark.parametrize("html,want", [("", ""), ("   ", ""), ("plain words\n here", "plain words here"), ("<p></p><div></div>", ""), ("<script>x</script>", ""), ("<p>one<p>two", "one\n\ntwo"), ("a < b and c", "a < b and c"), ("<div><p>text", "text"), ("</div></p>x", "x"), ("<body><p>" + "word " * 20000, ("word " * 20000).strip())])
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert "x" in main_text('<a href="' * 300 + "x")


def test_articles_of_the_table(spark, sf_dir):
    """The pages' article element holds the whole main text: compared with a plain reading of it."""
    import re
    from html import unescape

    for r in extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p|ul|ol|li|div|blockquote|h2|h3|table|tr|td|pre)\b[^>]*>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_extraction_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x", 2), (1, "u", "", 3)], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extracted(df).collect())
    assert got == [(0, None, "x", 1), (1, "u", "", 0), (1, "u", "", 0)]
    assert extracted(df.limit(0)).collect() == []


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    got = warc.op9_warc(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        b = pages[r["page_id"]]
        first = last[b] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(b), digest(b), "response" if first else "revisit", None if first else last[b])


def test_revisits_and_odd_rows(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u\nv", "ü"), (5, "u", "ü"), (None, "u", "n")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r["page"], r["record_type"], r["payload_bytes"], r["refers_to"], r["html"]) for r in warc.archive(df).collect()), key=lambda r: r[0] or "~")
    assert got == [
        ("1", "revisit", 4, "9", None), ("2", "revisit", 4, "9", None), ("3", "revisit", 0, "4", None), ("4", "response", 0, None, ""),
        ("5", "response", 2, None, "ü"), ("5", "response", 2, None, "ü"), ("9", "response", 4, None, "same"), (None, "response", 1, None, "n"),
    ]
    some = {(r["page"], r["record_type"]) for r in warc.archive(df, min_bytes=3).collect()}
    assert ("3", "response") in some and ("1", "revisit") in some
    assert warc.archive(df.limit(0)).collect() == []


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**9])
def test_each_record_belongs_to_one_range(split, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 97)
    dice = random.Random(3)
    noise = ["".join(chr(dice.randrange(32, 0x2FF)) for _ in range(dice.randrange(0, 400))) for _ in range(25)]
    data = b"".join(warc.record(str(i), "http://x/", t.encode(), None) for i, t in enumerate(noise))
    inner = gzip.compress(b"not a record")
    data = inner + data + inner
    found = []
    for start in range(0, len(data), split):
        found += [warc.parsed(m)[2].decode() for m in warc.members(io.BytesIO(data), len(data), start, min(len(data), start + split))]
    assert found == noise


ARTICLE = "<h1>A title here</h1>" + "".join(f"<p>{'words of the article stand here and go on ' * 5}{i}.</p>" for i in range(4))


@pytest.mark.parametrize("tag", ['div class="no-sidebar"', 'div class="has-sidebar content"', 'div class="article-with-comments"', 'div class="post-search"', 'div class="share"', "form"])
def test_wrappers_of_the_whole_page_do_not_empty_it(tag):
    name = tag.split()[0]
    side = '<div class="sidebar"><p>Other things one can read elsewhere on this site</p></div><form><p>Your name</p></form>'
    got = main_text(f"<html><body><nav><a href='/'>Home</a></nav><{tag}>{ARTICLE}{side}</{name}><footer>All rights</footer></body></html>")
    assert got == "\n\n".join(["A title here", *(" ".join(f"{'words of the article stand here and go on ' * 5}{i}.".split()) for i in range(4))])


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<b>", "</i><b>", "<a \"'", "<!--", "<p><", "<td></b>", "<script"])
def test_broken_pages_of_a_megabyte_take_linear_time(piece):
    began = time.perf_counter()
    main_text("<body><p>text</p>" + piece * (1_000_000 // len(piece)))
    main_text("<body><p>text</p>" + piece * (1_000_000 // len(piece)) + "</p>>")
    assert time.perf_counter() - began < 40
