"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table, text_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
#: Quoted values of one tag beyond which it ends at the next ">", so that broken quotes don't make a page take long.
QUOTES = 64
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
# Elements that format words inside a block; they count as text, not as tags.
INLINE = frozenset("abbr b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never part of the main text.
OUT = frozenset("script style noscript iframe template xmp noembed noframes head title nav footer aside button select option textarea input dialog menu svg canvas object audio video map search".split())
#: Words of class, id or role that hint at the same, not after "no-", "has-" or "with-". They and forms count only for an
#: element that has less than MOST percent of the body's text outside links, or not the page's headline or article element; comments go in any case unless they hold a headline or the article element.
MOST = 60
NOT_AFTER = "".join(f"(?<!{w}[\\s_-])" for w in ("no", "non", "has", "with", "without"))
COMMENT_WORDS = re.compile(rf"(?:^|[\s_-]){NOT_AFTER}(?:comment|comments|disqus|replies|respond)(?:$|[\s_-])", re.I)
OUT_WORDS = re.compile(
    rf"(?:^|[\s_-]){NOT_AFTER}" r"(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|aside|widget|widgets|related|recommended|recommendations|share|sharing|social|comment|comments|disqus|replies|respond|footer|masthead|search|toolbar|skip|complementary|contentinfo)(?:$|[\s_-])", re.I
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
#: What an opening tag ends: open elements of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("name", "parts", "out", "hint", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "most", "main")

    def __init__(self, name: str, out: bool, hint: int = 0):
        self.name, self.out, self.hint, self.parts = name, out, hint, []


def unwanted(name: str, attributes: str, inside: Counter[str]) -> tuple[bool, int]:
    """(is never main text, hint that it isn't: 1 by words, 2 by words for comments)."""
    if name in OUT:
        return True, 0
    if name == "header":
        return not (inside["article"] or inside["main"]), 0
    hint = int(name == "form")
    for key, value in NAMED.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            hint = 2 if COMMENT_WORDS.search(value) else hint or int(OUT_WORDS.search(value) is not None)
    return False, hint


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """("text" | "open" | "close", text or name, attributes, end) in page order; each character is looked at a bounded number of times. The caller may send a place to go on from."""
    at, size, last = 0, len(html), html.rfind(">")
    final = {q: html.rfind(q) for q in "\"'"}
    while at < size:
        start = html.find("<", at)
        if start < 0 or start > last:
            yield "text", html[at:], "", size
            return
        if start > at:
            yield "text", html[at:start], "", start
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("/", start + 1)
        m = NAME.match(html, start + 1 + closing)
        if m is None:
            if html[start + 1 : start + 2] in ("!", "?"):
                at = html.find(">", start) + 1
            else:
                at = start + 1
                yield "text", "<", "", at
            continue
        place, end = m.end(), -1
        for _ in range(QUOTES):
            stop = STOP.search(html, place)
            if stop is None:
                break
            if stop[0] == ">":
                end = stop.start()
                break
            if stop.start() >= final[stop[0]]:
                break
            place = html.find(stop[0], stop.end()) + 1
        if end < 0:
            end = html.find(">", m.end())
        at = end + 1
        sent = yield "close" if closing else "open", m[0].lower(), html[m.end() : end], at
        if sent is not None:
            at = sent
            yield "text", "", "", at


def tree(html: str) -> Node:
    """The document tree: an opening block ends an open paragraph, list items and cells end their siblings, and unknown closing tags count for nothing."""
    root = Node("#root", False)
    stack, names = [root], Counter()

    def end(i: int) -> None:
        names.subtract(n.name for n in stack[i:])
        del stack[i:]

    found = tokens(html)
    for what, name, attributes, at in found:
        if what == "text":
            if name:
                stack[-1].parts.append(name)
            continue
        if what == "close":
            if names[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        end(i)
                        break
                    if stack[i].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        if name in BLOCK and names["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    end(i)
                    break
                if stack[i].name in BLOCK:
                    break
        if name in CLOSES:
            ends, bound = CLOSES[name]
            if any(names[e] > 0 for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in bound:
                        break
                    if stack[i].name in ends:
                        end(i)
        node = Node(name, *unwanted(name, attributes, names))
        stack[-1].parts.append(node)
        if name in RAW:
            closed = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            found.send(closed.end() if closed else len(html))
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            names[name] += 1
    prune(root)
    return root


def prune(root: Node) -> None:
    """Takes hinted elements out that don't hold the page's main part."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [p for p in n.parts if type(p) is Node and not p.out]
    for n in reversed(order):
        chars, main = 0, n.name in ("article", "main", "h1")
        for p in n.parts:
            if type(p) is str:
                chars += len("".join(p.split()))
            elif not p.out:
                chars, main = chars + p.chars, main or p.main
        n.chars, n.main = 0 if n.name == "a" else chars, main
    body = next((n for n in order if n.name == "body"), root)
    for n in order:
        if n.hint == 2 and not n.main or n.hint == 1 and (100 * n.chars < MOST * body.chars or body.main and not n.main):
            n.out = True


def measure(root: Node) -> None:
    """Counts characters, tags, link characters and link tags of each subtree without the unwanted elements, then densities and their sums.

    Elements that only format words don't count as tags: a bold sentence is as dense as a plain one.
    """
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [p for p in n.parts if type(p) is Node and not p.out]
    for n in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for p in n.parts:
            if type(p) is str:
                chars += len("".join(p.split()))
            elif not p.out:
                chars, tags, link_chars, link_tags = chars + p.chars, tags + (p.name not in INLINE) + p.tags, link_chars + p.link_chars, link_tags + p.link_tags + (p.name == "a")
        n.chars, n.tags, n.link_chars, n.link_tags = chars, tags, chars if n.name == "a" else link_chars, link_tags
    body = next((n for n in order if n.name == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        n.density = c / t * math.log(max(c / max(lc, 1) * (t / lt), 1.0) + 1e-9) / math.log(base + 1e-9) if c and base > 1.0000001 else (c / t if c else 0.0)
        kids = [p for p in n.parts if type(p) is Node and not p.out]
        n.total = sum(p.density for p in kids)
        own = sum(len("".join(p.split())) for p in n.parts if type(p) is str)
        n.total += own  # text right in a node counts as a child of its own, of one tag
        n.best, n.most = n, n.total
        for p in kids:
            if p.most > n.most:
                n.best, n.most = p.best, p.most


def blocks(node: Node, into: list[str]) -> None:
    """Appends the text of each block in page order."""
    line: list[str] = []

    def close() -> None:
        if s := " ".join(unescape("".join(line)).split()):
            into.append(s)
        line.clear()

    todo: list = [node]
    while todo:
        p = todo.pop()
        if p is None:
            close()
        elif type(p) is str:
            line.append(p)
        elif p.out:
            if p.name in BLOCK:
                close()
        elif p.name == "br":
            line.append(" ")
        else:
            edge = [None] if p.name in BLOCK else []
            if edge:
                close()
            todo += [*edge, *reversed(p.parts)]
    close()


def main_text(html: str) -> str:
    """The main text, blocks joined by two line feeds; empty if there is none.

    The subtree with the largest sum of child densities is chosen; the smallest density on its path up to
    the body is the threshold, and every other subtree above the threshold adds its own largest-sum node.
    """
    root = tree(html)
    measure(root)
    body, todo = root, [root]
    while todo:
        n = todo.pop()
        if n.name == "body":
            body = n
            break
        todo += [p for p in reversed(n.parts) if type(p) is Node and not p.out]
    if not body.chars:
        body = root
    if not body.chars:
        return ""
    threshold, n = body.density, body
    while n is not body.best:
        threshold = min(threshold, n.density)
        n = next(p for p in n.parts if type(p) is Node and not p.out and p.best is body.best and p.most == body.most)
    threshold = min(threshold, n.density)
    chosen: set[int] = set()
    todo = [body]
    while todo:
        n = todo.pop()
        if n.density >= threshold and n.chars:
            chosen.add(id(n.best))
        todo += [p for p in n.parts if type(p) is Node and not p.out and p.chars]
    out: list[str] = []
    todo = [body]
    while todo:
        n = todo.pop()
        if id(n) in chosen:
            blocks(n, out)
        else:
            todo += [p for p in reversed(n.parts) if type(p) is Node and not p.out]
    return "\n\n".join(out)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row, from the whole html.

    Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and comments
    are left out wherever they stand; an element that only its class names as such, or a form, stays if it holds
    MOST percent of the body's text outside links and the headline or article element, if there is one. Broken markup takes time in proportion to the page. Null, empty and tag-only pages give an empty text; text without any
    tag is one block. Repeated rows give repeated rows, null ids and urls pass through, other columns are
    ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), text_of(pages, html).alias("html"))
    return in_batches(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
