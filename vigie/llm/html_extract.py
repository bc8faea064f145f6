"""Main-text extraction with a tree-structured graphical model over DOM nodes.

A page is parsed into its block elements and text blocks, a tree. Each node is
content or boilerplate. A node potential scores its tag, the words of its
class, id and role, and its text; a parent-child potential, by the kind of the
child, scores how labels go together. Sum-product messages pass upward from the
leaves and downward from the root and give each node's exact marginal; the text
blocks whose marginal is at least one half are the main text.

The potentials are trained from labelled pages: written layouts, whose labels
are known (``layouts``), and at most ``TRAIN_PAGES`` pages of the table that
mark their article with an ``article`` or ``main`` element. Node potentials are
a logistic regression, parent-child potentials smoothed counts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_PAGES = 200
SEED = 20261203

# HTML element names by how they are handled.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript xmp iframe noembed noframes template".split())
DROPPED = set("select button svg canvas audio video object datalist dialog menu".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li legend main nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSED_BY = {
    "p": BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
    "tr": {"tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"},
         "p": {"td", "th", "table", "caption", "button", "object"}}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


class Node:
    """An element that starts a block, or a text block (tag ``#text``)."""

    __slots__ = ("tag", "attrs", "parent", "text", "linked", "label", "chars", "link_chars")

    def __init__(self, tag: str, attrs: str, parent: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.text = ""
        self.linked = self.chars = self.link_chars = 0
        self.label = 0


def parse(page: str) -> list[Node]:
    """The page's nodes in page order, each after its parent; the first is the root."""
    nodes = [Node("html", "", -1)]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # (tag, its node or its block's, dropped)
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            node = Node("#text", "", stack[-1][1])
            node.text, node.linked = text, min(linked, len(text))
            nodes.append(node)
        pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            raw = html.unescape(raw)
            pieces.append(raw)
            if open_tags.get("a"):
                linked += len(raw.strip())

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            open_tags[tag] -= 1

    def close(tag: str, scope: set[str]) -> None:
        if open_tags.get(tag):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == tag:
                    return pop_to(d)
                if stack[d][0] in scope:
                    return

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            close(tag, set())
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        for inner, closers in CLOSED_BY.items():
            if tag in closers:
                close(inner, SCOPE[inner])
        if tag in BLOCK:
            flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        dropped = stack[-1][2] or tag in DROPPED
        node = stack[-1][1]
        if tag in BLOCK and not dropped:
            nodes.append(Node(tag, attrs, node))
            node = len(nodes) - 1
        stack.append((tag, node, dropped))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text(page[at:])
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.tag == "#text":
            node.chars, node.link_chars = len(node.text), node.linked
        up = nodes[node.parent]
        up.chars += node.chars
        up.link_chars += node.link_chars
    return nodes


def traits(node: Node) -> list[str]:
    """What the node potential looks at."""
    out = [f"tag:{node.tag}"]
    if node.attrs:
        out += [f"name:{x}" for x in names_of(node)]
        if re.search(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none", node.attrs, re.I):
            out.append("hidden")
    share = node.link_chars / node.chars if node.chars else 0.0
    out.append("links:" + ("none" if share < 0.05 else "some" if share < 0.5 else "most"))
    if node.tag == "#text":
        size = len(node.text)
        out.append("size:" + ("tiny" if size < 20 else "short" if size < 80 else "middle" if size < 300 else "long"))
        if len(node.text) < 200 and node.text.startswith(("©", "Copyright")):
            out.append("copyright")
    return sorted(set(out))


def kind(node: Node) -> str:
    """Children by how they take over their parent's label."""
    return "text" if node.tag == "#text" else "plain" if not node.attrs and node.tag in ("p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "dl", "dt", "dd", "figure", "figcaption", "blockquote", "pre", "td", "tr", "table", "tbody") else "part"


KINDS = ("text", "plain", "part")
BOILERPLATE = {"nav", "aside", "footer", "header", "form", "fieldset", "address"}


# Names that layouts give to content and to boilerplate parts.
CONTENT_NAMES = ("article", "article-body", "content", "post-content", "entry-content", "post", "story", "main", "main-content", "text", "body-text", "entry")
PARTS_OUT = (
    ("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("ol", "breadcrumbs"),
    ("div", "pagination"), ("div", "pager"), ("div", "toc"), ("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top-bar"),
    ("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("aside", ""), ("aside", "sidebar"),
    ("div", "sidebar"), ("div", "side"), ("div", "widget"), ("div", "related"), ("section", "related-posts"), ("div", "recommended"), ("div", "popular"), ("div", "trending"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "sponsor"), ("div", "promo"), ("div", "banner"),
    ("p", "ad"), ("div", "cookie"), ("div", "cookie-notice"), ("div", "cookies"), ("div", "consent"), ("div", "gdpr"), ("div", "notice"), ("p", "notice"), ("div", "alert"),
    ("div", "popup"), ("div", "modal"), ("div", "overlay"), ("div", "paywall"), ("div", "disclaimer"), ("form", ""), ("form", "search"), ("div", "search"), ("form", "newsletter"),
    ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "login"), ("form", "contact"), ("div", "share"), ("div", "social"),
    ("div", "sharing"), ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ul", "comments"), ("ol", "comment-list"), ("div", "comment-form"), ("article", "comment"), ("li", "comment"), ("section", "newsletter"), ("section", "comment-section"),
    ("div", "replies"), ("div", "reply"), ("div", "discussion"), ("div", "disqus"), ("div", "tags"), ("div", "skip"), ("div", "toolbar"), ("div", "announcement"),
)
FILLER = "the of and to in that it was for on are as with his they at be this from have or by one had not but what all were when".split()

# Single words of the names above that name a boilerplate part wherever they stand.
OUT_WORDS = {w for _, name in PARTS_OUT for w in name.split("-")} - {w for name in CONTENT_NAMES for w in name.split("-")} - {
    "", "bar", "list", "posts", "section", "side", "site", "skip", "top", "tags", "legal", "contact", "discussion"}


def names_of(node: Node) -> set[str]:
    """The words of its class, id and role."""
    return {x.lower() for m in NAMES.finditer(node.attrs) for x in PARTS.findall(m[1] or m[2] or m[3] or "")}


def mark(nodes: list[Node]) -> bool:
    """Label a page from its own markup: inside ``article`` or ``main``, outside of elements that are
    boilerplate by tag or name. False without any content."""
    any_content = False
    for node in nodes[1:]:
        out = node.tag in BOILERPLATE or bool(names_of(node) & OUT_WORDS)
        node.label = 0 if out else 1 if node.tag in ("article", "main") else nodes[node.parent].label
        any_content |= node.label == 1
    return any_content


def layouts(count: int = 400, seed: int = SEED) -> Iterator[list[Node]]:
    """Written pages with known labels: content containers of many names, boilerplate before, inside and after them."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(FILLER) for _ in range(rng.randint(a, b))).capitalize() + rng.choice((".", ".", "", "!"))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def out() -> str:
        tag, name = rng.choice(PARTS_OUT)
        named = rng.choice((f' class="{name}"', f' id="{name}"', f' class="x {name}"')) if name else ""
        body = rng.choice((links, lambda: words(2, 12), lambda: f"<p>{words(5, 40)}</p>", lambda: f"<p>{words(5, 30)}</p><p>{words(5, 60)}</p>",
                           lambda: f"<h{(n := rng.randint(2, 6))}>{words(1, 4)}</h{n}><p>{words(5, 40)}</p>",
                           lambda: f"<h{(n := rng.randint(2, 6))}>{words(1, 4)}</h{n}><div><p>{words(5, 40)}</p></div>", lambda: f"<div><p>{words(3, 40)}</p></div><div><p>{words(3, 40)}</p></div>"))()
        if tag in ("ul", "ol"):
            body = "".join(f"<li>{words(1, 25)}</li>" for _ in range(rng.randint(1, 5)))
        return f"<{tag}{named} data-y=0>{body}</{tag}>"

    def paragraph() -> str:
        form = rng.random()
        if form < 0.65:
            return f"<p>{words(1, 120)}</p>"
        if form < 0.7:
            return f"<p><a href='/z'>{words(1, 9)}</a></p>"
        if form < 0.78:
            level = rng.randint(2, 6)
            return f"<h{level}>{words(1, 8)}</h{level}>"
        if form < 0.84:
            return rng.choice((f"<ul><li>{words(1, 30)}</li><li>{words(1, 30)}</li></ul>", f"<ol><li>{words(1, 30)}</li><li>{words(1, 30)}</li></ol>",
                               f"<dl><dt>{words(1, 5)}</dt><dd>{words(1, 30)}</dd></dl>", f"<figure><figcaption>{words(1, 20)}</figcaption></figure>",
                               f"<section><h2>{words(1, 6)}</h2><p>{words(2, 60)}</p></section>", f"<p><a href='/z'>{words(2, 9)}</a></p>"))
        if form < 0.9:
            return f"<blockquote>{words(4, 40)}</blockquote>"
        if form < 0.94:
            return f"<pre>{words(4, 40)}</pre>"
        if form < 0.97:
            return f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>"
        return f"<div><p>{words(3, 60)} <a href='/y'>{words(1, 4)}</a> {words(1, 20)}</p></div>"

    for _ in range(count):
        inner = f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 12)):
            inner += paragraph() + (out() if rng.random() < 0.12 else "")
        how = rng.random()
        name = rng.choice(CONTENT_NAMES)
        if how < 0.3:
            inner = f"<article data-y=1>{inner}</article>"
        elif how < 0.45:
            inner = f"<main data-y=1>{inner}</main>"
        elif how < 0.55:
            inner = f"<main data-y=1><article data-y=1>{inner}</article></main>"
        elif how < 0.9:
            inner = f'<{rng.choice(("div", "section"))} {rng.choice(("class", "id"))}="{name}" data-y=1>{inner}</div></section>'
        else:
            inner = f"<div data-y=1>{inner}</div>"
        for _ in range(rng.randint(0, 2)):
            inner = f"<div>{inner}</div>" if rng.random() < 0.5 else f'<div class="{rng.choice(("container", "wrapper", "page", "row"))}">{inner}</div>'
        page = "".join(out() for _ in range(rng.randint(1, 4))) + inner + "".join(out() for _ in range(rng.randint(1, 4)))
        nodes = parse(page)
        for node in nodes[1:]:
            own = re.search(r"data-y=([01])", node.attrs)
            node.label = int(own[1]) if own else nodes[node.parent].label
            node.attrs = re.sub(r"\s*data-y=[01]", "", node.attrs)
        yield nodes


def majority(nodes: list[Node]) -> None:
    """A container's label is that of most of its text."""
    inside = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.tag == "#text":
            inside[i] = node.chars * node.label
        elif node.chars:
            node.label = int(2 * inside[i] >= node.chars)
        inside[node.parent] += inside[i]
    nodes[0].label = int(2 * inside[0] >= nodes[0].chars)


def train(pages: list[list[Node]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> dict:
    """Potentials from labelled trees: {"weights": trait -> weight, "pair": kind -> four log potentials}."""
    samples: list[tuple[list[str], int]] = []
    pair = {k: np.ones((2, 2)) for k in KINDS}
    for nodes in pages:
        majority(nodes)
        for node in nodes[1:]:
            if node.chars:
                samples.append((traits(node), node.label))
                pair[kind(node)][nodes[node.parent].label, node.label] += 1
    names = {x: i for i, x in enumerate(sorted({t for s, _ in samples for t in s}))}
    rows = np.repeat(np.arange(len(samples)), [len(s) for s, _ in samples])
    columns = np.array([names[t] for s, _ in samples for t in s])
    y = np.array([label for _, label in samples], dtype=float)
    often = np.bincount(columns, minlength=len(names)) + 20.0  # rare traits move less
    w, base = np.zeros(len(names)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[columns], len(y)) + base)))
        gap = p - y
        w -= rate * 8 * (np.bincount(columns, gap[rows], len(names)) / often + decay * w)
        base -= rate * gap.mean()
    share = min(max(y.mean(), 0.01), 0.99)
    # the prior is in both potentials; it is taken out of the parent-child part
    logs = {k: np.log(c / c.sum(1, keepdims=True)) - np.log([1 - share, share]) for k, c in pair.items()}
    return {"weights": {x: float(w[i]) for x, i in names.items()}, "base": float(base), "pair": {k: tuple(float(v) for v in c.reshape(-1)) for k, c in logs.items()}}


def soft(a: float, b: float) -> float:
    """log(e**a + e**b)."""
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Log-odds of content of every node: one upward and one downward sweep of sum-product messages."""
    weights, base, pair = model["weights"], model["base"], model["pair"]
    total = [0.0] * len(nodes)
    up = [0.0] * len(nodes)
    kinds = [kind(node) for node in nodes]
    for i, node in enumerate(nodes):
        if i and node.chars:
            total[i] = base + sum(weights.get(t, 0.0) for t in traits(node))
    for i in range(len(nodes) - 1, 0, -1):
        p00, p01, p10, p11 = pair[kinds[i]]
        up[i] = soft(p10, p11 + total[i]) - soft(p00, p01 + total[i])
        total[nodes[i].parent] += up[i]
    for i in range(1, len(nodes)):
        p00, p01, p10, p11 = pair[kinds[i]]
        rest = total[nodes[i].parent] - up[i]  # what the parent knows besides this child
        total[i] += soft(p01, p11 + rest) - soft(p00, p10 + rest)
    return total


def main_text(page: str | None, model: dict) -> str:
    """The page's content blocks in page order, one per line."""
    nodes = parse(page or "")
    odds = marginals(nodes, model)
    return "\n".join(node.text for node, x in zip(nodes, odds, strict=True) if node.tag == "#text" and x >= 0)


def extractor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(page, own) for page in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def fit_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> dict:
    """Train on the written layouts and at most ``train_pages`` pages of the table that mark their article."""
    marked = pages.where(F.rlike(F.col(html_col), F.lit(r"(?i)<(?:article|main)[\s>]"))).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    # a bound on the hash leaves a few times as many pages as needed, so that tasks send no more than these, whatever their number
    marked = marked.withColumn("h", F.xxhash64(F.lit(SEED), "id", "html"))
    share = min(1.0, (4 * train_pages + 100) / max(1, marked.select(F.lit(1)).count()))
    few = marked if share == 1.0 else marked.where(F.col("h") < F.lit(int(share * 2**64) - 2**63))
    sample = few.groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(train_pages).collect()  # a repeated row counts once
    trees = list(layouts())
    for row in sample:
        nodes = parse(row["html"])
        if mark(nodes):
            trees.append(nodes)
    return train(trees)


def extract(pages: DataFrame, carry: list[str], html_col: str = "html", id_col: str = "page_id", model: dict | None = None) -> DataFrame:
    """``carry``, text, n_chars: one row per input row.

    Character references are decoded, white space inside a block (``br``
    included) becomes one space, blocks are trimmed and joined by one line
    break; nothing else is dropped or cut. NULL and empty pages give the empty
    text; broken markup is closed as a browser would roughly do; repeated rows
    are extracted each. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    model = fit_pages(pages, id_col, html_col) if model is None else model
    rows = pages.select(F.struct(*carry).alias("row"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    found = rows.mapInArrow(extractor(pages.sparkSession.sparkContext.broadcast(model)), schema)
    return found.select(*[F.col("row")[c].alias(c) for c in carry], "text", F.length("text").cast("long").alias("n_chars"))
