"""Language identification, quality classifier and HTML extraction: held-out accuracy and exact checks of the mathematics."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigie.llm import html_extract as H
from vigie.llm import language_id as L
from vigie.llm import quality as Q
from vigie.llm.ragged import ALNUM, NOT_SPACE, Words, slices, texts, window_rows

from .conftest import edge_rows


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


# language identification


def brute_ppm(train, order):
    """counts[lang][context][byte] of plain PPM."""
    counts = {}
    for lang, data in train:
        tree = counts.setdefault(lang, {})
        for i, k in itertools.product(range(len(data)), range(order + 1)):
            if i >= k:
                tree.setdefault(data[i - k : i], Counter())[data[i]] += 1
    return counts


def brute_bits(tree, data, order):
    total = 0.0
    for i, byte in enumerate(data):
        for k in range(min(order, i), -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if byte in seen:
                total -= math.log2(seen[byte] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_ppm_code_lengths(spark):
    train = [("aa", b"abracadabra abra"), ("aa", b"cabbage"), ("bb", "das ist ein öder Tag".encode()), ("bb", b"")]
    probes = ["abracadabra", "ein Tag", "zzz", "", "ö", "abra das"]
    order = 3
    rows = spark.createDataFrame([(a, b.decode()) for a, b in train], "lang string, text string")
    counts = rows.mapInArrow(L.counter(order), "lang string, length long, gram long, n long").groupBy("lang", "length", "gram").sum("n").toDF(
        "lang", "length", "gram", "n").toPandas()
    model = L.build(counts, order)
    got = L.identify(spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "doc_id long, text string"), model, ["doc_id"]).collect()
    trees = brute_ppm(train, order)
    for r in got:
        want = [brute_bits(trees[x], probes[r["doc_id"]].encode(), order) for x in ("aa", "bb")]
        assert np.allclose(r["bits"], want, rtol=1e-5)
        if probes[r["doc_id"]]:
            assert r["lang_pred"] == ("aa", "bb")[int(np.argmin(want))]
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_language_held_out(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = L.language_id(docs).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_language_ignores_held_out_labels(docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(L.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(str, L.language_id(docs).collect())) == sorted(map(str, L.language_id(other).collect()))


def test_language_edges(edge, empty):
    got = L.language_id(edge).collect()
    assert len(got) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 20))
    assert all(r["lang_pred"] in ("en", "de", "und") for r in got)
    assert L.language_id(empty).collect() == []


# quality classifier


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = Q.quality(big, labels).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([r["score"] for r in out if truth[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95


def test_quality_reruns_and_held_out_labels(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(str, Q.quality(x, y).collect())) for x, y in ((docs, labels), (docs.repartition(5), turned)))
    assert a == b


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(edge, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    kept = Q.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r["predicted"] for r in got)
    assert Q.quality(empty, labels).collect() == []
    none = Q.quality(edge, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y)
    assert (0, 1) in model["pairs"] and ((Q.score(model, x) > 0.5) == y).mean() > 0.97


# words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1é .\n\x0b…", max_size=12), max_size=6))
def test_words_match_regex(rows):
    import re

    import pyarrow as pa

    data, offsets = texts(pa.array(rows, pa.string()))
    for is_word, pattern in ((ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_SPACE, rb"[^\x20\x09-\x0D]+")):
        found = []
        for a, b in slices(offsets, 10):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word)
            found += [[w.text(i, i + 1) for i in range(w.first[r], w.first[r + 1])] for r in range(b - a)]
            starts, per_row = window_rows(w.first, 2)
            assert len(starts) == per_row.sum() == sum(max(0, n - 1) for n in w.count)
        assert found == [re.findall(pattern, t.lower().encode() if t.isascii() else t.replace("B", "b").encode()) for t in rows]


# HTML extraction


@pytest.fixture(scope="module")
def model():
    return H.train(list(H.layouts()))


def test_marginals_are_exact(model):
    """Messages against the sum over all labelings of small trees."""
    rng = random.Random(2)
    for _ in range(20):
        nodes = [H.Node("html", "", -1)]
        for i in range(1, 8):
            node = H.Node(rng.choice(("div", "p", "nav", "#text")), rng.choice(("", 'class="ad"')), rng.randrange(i))
            node.text, node.chars = "some words", 10
            nodes.append(node)
        total = [0.0, 0.0]
        weight = np.zeros((len(nodes), 2))
        unary = [0.0] + [model["base"] + sum(model["weights"].get(t, 0.0) for t in H.traits(n)) for n in nodes[1:]]
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            logp = sum(u * y for u, y in zip(unary, labels, strict=True))
            logp += sum(model["pair"][H.kind(n)][2 * labels[n.parent] + labels[i]] for i, n in enumerate(nodes) if i)
            for i, y in enumerate(labels):
                weight[i, y] += math.exp(logp)
        assert np.allclose(H.marginals(nodes, model), np.log(weight[:, 1] / weight[:, 0]), atol=1e-6), total


def test_held_out_layouts(model):
    wrong = total = 0
    for nodes in H.layouts(150, seed=99):
        labels = [n.label for n in nodes]
        for n, y, odds in zip(nodes, labels, H.marginals(nodes, model), strict=True):
            if n.tag == "#text":
                total, wrong = total + 1, wrong + ((odds >= 0) != y)
    assert wrong < 0.02 * total


def test_page(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x</p>";</script></head><body>
    <header class="site-header"><a href="/">Home</a><p>The best site in the world since 1999.</p></header>
    <div id="cookie-banner">We use cookies to improve your experience on our site, please accept them.</div>
    <div class="layout"><div class="sidebar"><h3>Popular</h3><p>Plain words that are long enough to look like an article, really.</p></div>
    <div class="post-body"><h1>Title &amp; more</h1><p>First \n para with <b>bold</b> and <a href=x>link</a> text.</p><div class="advert">Buy this now!</div>
    <p>Second.<br>line &lt;b&gt; &#233;<p>Short<ul><li>one<li>two</ul><form><label>Mail</label><input><button>Send</button></form>
    <p>Last.<!-- <p>no</p> --></div></div>
    <section id="comments"><h2>3 Comments</h2><div class="comment"><p>I really liked this article, thank you for writing it.</p></div></section>
    <footer>© 2020 Site</footer></body></html>"""
    assert H.main_text(page, model) == "Title & more\nFirst para with bold and link text.\nSecond. line <b> é\nShort\none\ntwo\nLast."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  ", ""), ("plain text", "plain text"), ("<article>only <i>this</i></article><nav>menu</nav>", "only this"),
    ("<article><p>open <b>never closed", "open never closed"), ("<article><p>a < b & c</p></article>", "a < b & c"), ("<article></p>x</div></article>", "x"),
    ("<article><p title='>'>quoted</p><p a=\"x>unclosed</p></article>", None), ("<nav><a href=x>a</a></nav>", ""), ("<", "<"), ("<!--", ""), ("<script>x", ""),
])
def test_broken_pages(model, page, want):
    got = H.main_text(page, model)
    assert want is None or got == want


def test_deep_page(model):
    assert H.main_text("<div>" * 20_000 + "<p>deep</p>", model) in ("deep", "")
    assert H.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>", model).count("\n") == 19_999


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages, ["page_id", "url"]).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        nodes = H.parse(r["html"])
        H.mark(nodes)
        want = "\n".join(n.text for n in nodes if n.tag == "#text" and n.label)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pages_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>Some words here.</p>", "x"), (None, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df, ["page_id", "url"]).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("Some words here.", 16)]
    assert H.extract(df.limit(0), ["page_id", "url"]).collect() == []
