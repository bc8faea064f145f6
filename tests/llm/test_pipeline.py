"""The pipeline against its stages' brute-force versions, and the registration of the queries."""

import re
import zlib
from collections import Counter

import corpus_pipeline as P
from vigie.llm.queries import ORACLE_SQL, QUERIES
from vigie.llm.quality import quality

from .conftest import SF, edge_rows, lowered
from .test_pairs import brute_components, shingle_sets


def test_registration():
    import __spark_entry__ as E

    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in QUERIES) == 1 for n in names)
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
    assert 4 <= len(P.STAGES) <= 5


def test_stages(spark):
    docs = P.table(spark, SF, "documents")
    labels = P.table(spark, SF, "labels")
    at = docs
    results = []
    for name, stage in P.STAGES:
        at = P.cut(stage(spark, at, SF))
        results.append(at)
        if name != "sharding":
            assert at.columns == docs.columns
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in results]
    good = {r["doc_id"] for r in quality(docs, labels).collect() if r["predicted"]}
    assert set(ids[0]) == good and len(ids[0]) == len(good)
    rows = [(r["doc_id"], r["text"]) for r in results[0].collect()]
    comps = brute_components(shingle_sets(rows, 5))
    assert sorted(ids[1]) == sorted(i for i, c in comps.items() if i == c)
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    bench = [words(r["text"]) for r in P.table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[j : j + min(10, len(w))]) for w in bench for j in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    text = dict(rows)
    clean = [i for i in ids[1] if not any(tuple(w[j : j + n]) in windows for w in [words(text[i])] for n in sizes for j in range(len(w) - n + 1))]
    assert sorted(ids[2]) == sorted(clean)
    copies = Counter(ids[3])
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    assert Counter(ids[4]) == copies
    shards = results[4].collect()
    assert sorted(r["text_crc32"] for r in shards) == sorted(zlib.crc32((text[i] or "").encode()) for i in ids[3])
    for s in {r["shard"] for r in shards}:
        assert sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(sum(r["shard"] == s for r in shards)))


def test_run(spark):
    a, b = (sorted(map(str, P.run(spark, SF).select("doc_id", "size", "text_crc32", "shard").collect())) for _ in range(2))
    assert a == b and a


def test_stages_on_edges(spark, edge, empty):
    at = edge
    for name, stage in P.STAGES[1:]:
        at = P.cut(stage(spark, at, SF))
        if name != "sharding":
            assert at.columns == edge.columns
    assert at.count() > 0 and len(edge_rows())
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
