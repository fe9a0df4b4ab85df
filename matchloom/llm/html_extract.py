"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a node with two states, content or not. Its own evidence is a product of feature likelihoods, all of the
node alone: tag, words of class and id, and its own text. A paragraph looks the same in an article, a comment and a footer; what
tells them apart comes from above and below, through the potential P(child | parent) between parent and child. All tables are counted, with add-one smoothing, from labelled pages. Sum-product messages go up from
the leaves and down from the root, which is exact on a tree, and give each node's marginal; the text of nodes that are
likelier content than not is kept, block by block.

The labelled pages are built here from a seed: ``labelled_pages(n, seed)`` varies layouts, wrappers, names and boilerplate,
and knows which elements are content; comments and other boilerplate have paragraphs as an article has. n (default 400) is the
bound of the sample.

Parsing follows HTML's rules as far as text needs them: quoted attributes, comments, raw text elements, void elements,
implied ends of p, li, dt, dd, option and table parts, end tags without a begin, and input that breaks off anywhere. It uses
no recursion, so depth is no limit.

Cases: null or empty html: empty text. Very long or deep pages: time and memory in proportion to the page. A page without content nodes: empty text. Repeated rows: equal results. A null
page_id or url: null. Empty table: no rows. Other columns: ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices

#: Element names of HTML, by what they do to text.
RAW = set("script style title textarea noscript template iframe noframes xmp svg math select".split())
FOREIGN = {"svg", "math"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"} | {"li", "dd", "dt"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words in class and id that speak against content, and for it.
AGAINST = set("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead topbar cookie consent notice alert popup modal comment comments reply replies discussion disqus respond share sharing social related recommended more widget newsletter subscribe signup login form search pagination pager tags meta legal copyright disclaimer toolbar".split())
FOR = set("article content post entry story main body text page prose maincontent articlebody hentry copy".split())

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[!?/][^>]*(?:>|$))", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_STOPS = re.compile(r"[.,;:!?]")


class Tree:
    """Block elements in page order, and runs of text in page order. A parent comes before its children."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#page"]
        self.names: list[str] = [""]
        self.texts: list[tuple[int, str]] = []  # (node, text) of each block of running text
        self.chars: list[int] = [0]
        self.linked: list[int] = [0]
        self.stops: list[int] = [0]


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and their nodes; inline ones have their block's
    run: list[str] = []
    run_chars = links = linked = 0
    at, n = 0, len(page)

    def close_run() -> None:
        nonlocal run, run_chars, linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                node = stack[-1][1]
                tree.texts.append((node, text))
                tree.chars[node] += len(text)
                tree.linked[node] += min(linked, len(text))
                tree.stops[node] += len(_STOPS.findall(text))
        run, run_chars, linked = [], 0, 0

    def pop_to(k: int) -> None:
        nonlocal links
        if any(name in BLOCKS for name, _ in stack[k:]):
            close_run()
        links -= sum(name == "a" for name, _ in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            run.append(page[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if name in VOID:
            if name == "hr":
                close_run()
            elif name == "br":
                run.append(" ")
            continue
        if name in RAW:
            # only foreign elements (svg, math) may close themselves; a slash at the end of an unquoted value is part of it
            if not (name in FOREIGN and _CLOSED.search(rest)):
                m = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = m.end() if m else n
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in FENCES[name]:
                    break
                if stack[k][0] in IMPLIED[name]:
                    pop_to(k)
                    break
        if name in BLOCKS:
            close_run()
            tree.parent.append(stack[-1][1])
            tree.tag.append(name)
            tree.names.append(" ".join(x or y or z for x, y, z in _NAMES.findall(rest)) if rest else "")
            tree.chars.append(0)
            tree.linked.append(0)
            tree.stops.append(0)
            stack.append((name, len(tree.parent) - 1))
        else:
            links += name == "a"
            stack.append((name, stack[-1][1]))
    close_run()
    return tree


FEATURES = ("tag", "names", "text")


def described(tree: Tree) -> list[tuple]:
    """A value of each feature for each node, from the node alone: its tag, the words of its class and id, and its own running
    text (not that of nodes inside it) by amount, share of links and punctuation."""
    out = []
    for tag, names, chars, linked, stops in zip(tree.tag, tree.names, tree.chars, tree.linked, tree.stops, strict=True):
        words = {w.lower() for w in _WORD.findall(names)}
        spoken = ("against" if words & AGAINST else "for" if words & FOR else "other") if words else "none"
        text = (int(linked / chars * 1.999), 1 + (chars >= 40) + (chars >= 200), 0 if chars < 10 else min(2, int(100 * stops / chars))) if chars else "none"
        out.append((tag, spoken, text))
    return out


class Model:
    """Log tables of the tree model; fitted by counting."""

    def __init__(self, pages: list[tuple[str, set[int]]]):
        """pages: html, and the numbers (page order) of its content nodes."""
        values: list[dict] = [{} for _ in FEATURES]
        edge = np.ones((2, 2))
        by_kind: dict[tuple, np.ndarray] = {}
        total = np.zeros(2)
        for page, content in pages:
            tree = parse(page)
            rows = described(tree)
            for k, row in enumerate(rows):
                y = int(k in content)
                total[y] += 1
                for table, v in zip(values, row, strict=True):
                    table.setdefault(v, np.zeros(2))[y] += 1
                if k:
                    x = int(tree.parent[k] in content)
                    edge[x, y] += 1
                    by_kind.setdefault(rows[tree.parent[k]][:2], np.zeros((2, 2)))[x, y] += 1
        # P(child | parent): of parents with this tag and kind of names, drawn towards that of all parents
        share = edge / edge.sum(axis=1, keepdims=True)
        told = lambda n: np.log((n + 4 * share) / (n + 4 * share).sum(axis=1, keepdims=True)).tolist()
        self.edge, self.edges = told(np.zeros((2, 2))), {kind: told(n) for kind, n in by_kind.items()}
        self.tables = [{v: tuple(np.log((c + 1) / (total + len(t) + 1)).tolist()) for v, c in t.items()} for t in values]

    def marginals(self, tree: Tree) -> list[float]:
        """log-odds of content of each node given the whole page."""
        rows, parent = described(tree), tree.parent
        n = len(rows)
        own0, own1 = [0.0] * n, [0.0] * n
        for k, row in enumerate(rows):
            a = b = 0.0
            for table, v in zip(self.tables, row, strict=True):
                x = table.get(v)
                if x is None:  # a value that no labelled page has speaks for neither
                    continue
                a += x[0]
                b += x[1]
            own0[k], own1[k] = a, b
        own1[0] = own0[0] - 50.0  # the page as a whole is no content
        edge = [self.edges.get(rows[p][:2], self.edge) for p in parent]  # of a node to its parent; the root's is not used
        up0, up1 = [0.0] * n, [0.0] * n  # message of k to its parent, by the parent's state
        for k in range(n - 1, 0, -1):
            a, b, p = own0[k], own1[k], parent[k]
            (e00, e01), (e10, e11) = edge[k]
            up0[k], up1[k] = _sum(e00 + a, e01 + b), _sum(e10 + a, e11 + b)
            own0[p] += up0[k]
            own1[p] += up1[k]
        odds = [0.0] * n
        all0, all1 = own0, own1  # now beliefs without the message from above
        odds[0] = all1[0] - all0[0]
        for k in range(1, n):
            p = parent[k]
            (e00, e01), (e10, e11) = edge[k]
            a, b = all0[p] - up0[k], all1[p] - up1[k]
            all0[k] += _sum(a + e00, b + e10)
            all1[k] += _sum(a + e01, b + e11)
            odds[k] = all1[k] - all0[k]
        return odds

    def without_edges(self) -> Model:
        """The same evidence with parent and child independent: what the messages are worth."""
        out = copy(self)
        out.edge, out.edges = [[-log(2)] * 2] * 2, {}
        return out

    def text(self, page: str) -> str:
        tree = parse(page)
        odds = self.marginals(tree)
        return "\n".join(t for node, t in tree.texts if odds[node] > 0)


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a + log1p(exp(b - a))


class _Builder:
    """Writes a page and notes which of its block elements are content."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.nodes = 0
        self.content: set[int] = set()

    def open(self, tag: str, good: bool, names: str = "") -> None:
        self.nodes += 1
        if good:
            self.content.add(self.nodes)
        self.out.append(f'<{tag} class="{names}">' if names else f"<{tag}>")

    def leaf(self, tag: str, good: bool, inside: str, names: str = "", close: bool = True) -> None:
        self.open(tag, good, names)
        self.out.append(inside + (f"</{tag}>" if close else ""))

    def end(self, tag: str) -> None:
        self.out.append(f"</{tag}>")


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, set[int]]]:
    """n pages of varied layout with their content nodes."""
    r = random.Random(seed)
    syllables = "an re ta li on er mi so ve ku da lo pe ri ten sha".split()

    def words(k: int, stops: bool = True) -> str:
        out = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(max(1, k))]
        if stops and r.random() < 0.75:
            out = [w + r.choice(",..") if r.random() < 0.15 else w for w in out]
            out[-1] = out[-1].rstrip(",.") + "."
        return " ".join(out)

    def link(k: int = 1) -> str:
        return f'<a href="/{words(1, False)}">{words(k, False)}</a>'

    def menu(b: _Builder, tag: str, names: str = "") -> None:
        b.open(tag, False, names)
        if r.random() < 0.7:
            b.open("ul", False)
            for _ in range(r.randint(2, 8)):
                b.leaf("li", False, link(r.randint(1, 3)))
            b.end("ul")
        else:
            b.out.append(" | ".join(link() for _ in range(r.randint(2, 6))))
        b.end(tag)

    def small(b: _Builder, tag: str, names: str = "") -> None:
        b.open(tag, False, names)
        for _ in range(r.randint(0, 3)):
            b.leaf(r.choice(("p", "p", "div", "h3")), False, words(r.choice((r.randint(2, 18), r.randint(12, 80)))))
        b.out.append(words(r.randint(1, 25)) if r.random() < 0.8 else link(3))
        b.end(tag)

    def remark(b: _Builder) -> None:
        tag = r.choice(("section", "div"))
        b.open(tag, False, r.choice(("comments", "comment-list", "discussion", "replies")))
        for _ in range(r.randint(1, 9)):
            b.open(r.choice(("div", "li")), False, r.choice(("comment", "", "row")))
            t = b.out[-1][1:].split(" ")[0]
            for _ in range(r.randint(1, 3)):
                b.leaf("p", False, words(r.choice((r.randint(1, 12), r.randint(12, 80), r.randint(40, 160)))))
            if r.random() < 0.3:
                b.leaf(r.choice(("h2", "h3", "blockquote")), False, words(r.randint(1, 9), False))
            b.end(t)
        b.end(tag)

    def form(b: _Builder) -> None:
        b.open("form", False, r.choice(("", "newsletter", "search", "subscribe")))
        b.leaf(r.choice(("p", "div")), False, f"{words(r.randint(2, 12))} <input name=q><button>{words(1, False)}</button>")
        b.end("form")

    def article(b: _Builder) -> None:
        kind = r.random()
        tag, names = ("article", r.choice(("", "", "post", "story"))) if kind < 0.6 else ("main", r.choice(("", "content"))) if kind < 0.75 else ("div", r.choice(("content", "post entry", "article-body", "story text", "main")))
        b.open(tag, True, names)
        if r.random() < 0.85:
            if r.random() < 0.25:
                b.open("header", True)
                b.leaf("h1", True, words(r.randint(2, 12), False))
                b.end("header")
            else:
                b.leaf("h1", True, words(r.randint(2, 12), False))
        inner = r.random() < 0.25
        if inner:
            b.open(r.choice(("div", "section")), True, r.choice(("", "content", "text", "body")))
            inside = b.out[-1][1:].split(">")[0].split(" ")[0]
        for _ in range(r.randint(1, 10)):
            x = r.random()
            if x < 0.6:
                text = words(r.choice((r.randint(1, 12), r.randint(12, 80), r.randint(40, 160))))
                if r.random() < 0.05:
                    text = " ".join([text.split(" ")[0]] * r.randint(3, 40))
                if r.random() < 0.2:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f"{text} {link(2)} {words(5)}"
                b.leaf("p", True, text, close=r.random() < 0.85)
            elif x < 0.68:
                b.leaf(r.choice(("h2", "h3")), True, words(r.randint(1, 7), False))
            elif x < 0.84:
                b.open("ul" if r.random() < 0.6 else "ol", True)
                t = b.out[-1][1:3]
                for _ in range(r.randint(1, 5)):
                    b.leaf("li", True, words(r.randint(2, 25)))
                b.end(t)
            elif x < 0.9:
                b.open("blockquote", True)
                b.leaf("p", True, words(r.randint(5, 50)))
                b.end("blockquote")
            elif x < 0.93:
                b.open("figure", True)
                b.leaf("figcaption", True, words(r.randint(2, 15)))
                b.end("figure")
            elif x < 0.95:
                b.leaf("pre", True, words(r.randint(3, 30)))
            else:
                small(b, r.choice(("div", "aside")), r.choice(("ad", "share", "related", "promo", "advert")))
        if inner:
            b.end(inside)
        b.end(tag)

    pages = []
    for _ in range(n):
        b = _Builder()
        b.out.append(f"<!DOCTYPE html><title>{words(5)}</title><style>p{{}}</style>")
        b.open("html", False)
        b.open("body", False, r.choice(("", "", "page")))
        if r.random() < 0.4:
            b.open("header", False, r.choice(("", "masthead", "site-header")))
            b.leaf(r.choice(("h1", "div", "p")), False, link(2) if r.random() < 0.5 else words(2, False))
            if r.random() < 0.5:
                menu(b, "nav")
            b.end("header")
        if r.random() < 0.7:
            menu(b, *(("nav", "") if r.random() < 0.6 else ("div", r.choice(("menu", "navbar", "breadcrumb")))))
        for _ in range(r.randint(0, 2)):
            small(b, "div", r.choice(("ad", "cookie-notice", "banner", "alert notice", "promo", "ads")))
        wrapped = r.random() < 0.3
        if wrapped:
            b.open("div", False, r.choice(("", "wrapper", "container", "row")))
        if r.random() < 0.2:
            small(b, "aside", r.choice(("", "sidebar")))
        article(b)
        if r.random() < 0.35:
            (menu if r.random() < 0.5 else small)(b, *(("aside", r.choice(("", "sidebar"))) if r.random() < 0.6 else ("div", r.choice(("sidebar", "related", "widget")))))
        if r.random() < 0.75:
            remark(b)
        if r.random() < 0.3:
            form(b)
        if wrapped:
            b.end("div")
        if r.random() < 0.9:
            if r.random() < 0.7:
                b.leaf("footer", False, words(r.randint(2, 30)) + (link() if r.random() < 0.4 else ""))
            else:
                small(b, *(("footer", "") if r.random() < 0.5 else ("div", "footer")))
        b.out.append("</body></html>")
        pages.append(("".join(b.out), b.content))
    return pages


@lru_cache(maxsize=4)
def model(pages: int = 400, seed: int = 11) -> Model:
    return Model(labelled_pages(pages, seed))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = 400, seed: int = 11) -> DataFrame:
    """page_id, url, text, n_chars of each page; no shuffle. The model is fitted on the driver and goes with the task."""
    fitted = model(training_pages, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [fitted.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
