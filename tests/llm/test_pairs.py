"""Exact and near deduplication and repeated strings against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from vigie.llm.components import components
from vigie.llm.exact_dedup import exact_dedup
from vigie.llm.near_dedup import near_dedup
from vigie.llm.suffix_dedup import suffix_dedup, window_rows_of

from .conftest import edge_rows, lowered


def test_exact_edges(edge):
    got = sorted(exact_dedup(edge).collect(), key=str)
    groups = defaultdict(list)
    for i, t, *_ in edge_rows():
        groups[lowered(t)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_empty(empty):
    assert exact_dedup(empty).collect() == []


def shingle_sets(rows, n=4):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", lowered(t))
        out[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute_components(sets, threshold=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_edges(edge):
    rows = [(i, t) for i, t, *_ in edge_rows() if i is not None]
    sets = shingle_sets(rows)
    comps = brute_components(sets)
    got = near_dedup(edge).collect()
    assert len(got) == len(edge_rows())
    for i, n, c, kept in got:
        if i is None:
            assert c is None and kept
        else:
            assert (n, c, kept) == (len(sets[i]), comps[i], comps[i] == i)


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_brute_force(docs, rounds):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comps = brute_components(shingle_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(docs, rounds=rounds).collect()}
    assert got == comps


def test_near_chain(spark):
    """Each text is near the next one only: one component through all of them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[6 * k : 6 * k + 100])) for k in range(12)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    comps = brute_components(shingle_sets(rows))
    assert {r["doc_id"]: r["component_id"] for r in got} == comps and len(set(comps.values())) == 1


def test_near_empty(empty):
    assert near_dedup(empty).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (7, 7)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components(edges).collect()} == {(i, 1) for i in range(1, 6)} | {(8, 8), (9, 8)}


def brute_repeats(rows, window=200):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[j : j + window] for j in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - window + 1):
            if count[b[j : j + window]] > 1:
                gone[j : j + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_edges(edge, hot):
    want = brute_repeats([(i, t) for i, t, *_ in edge_rows()])
    assert sorted(map(tuple, suffix_dedup(edge, hot=hot).collect()), key=str) == want
    assert sum(w[2] for w in want) > 1000


def test_repeats_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, suffix_dedup(docs).collect()), key=str) == brute_repeats(rows)


def test_repeats_in_pieces_of_long_texts(edge, monkeypatch):
    from vigie.llm import anchors

    monkeypatch.setattr(anchors, "PIECE", 97)
    assert sorted(map(tuple, suffix_dedup(edge).collect()), key=str) == brute_repeats([(i, t) for i, t, *_ in edge_rows()])


def test_repeats_kept_bytes(edge):
    for r in suffix_dedup(edge, keep_text=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_repeats_of_other_windows(spark, edge):
    with pytest.raises(ValueError, match="gram of at least 33"):
        suffix_dedup(edge, window=288)
    text = "".join(f"{i:04x}" for i in range(400))
    rows = [(1, "head" + text), (2, text + "tail"), (3, text[:280])]
    got = sorted(map(tuple, suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=287).collect()))
    assert got == brute_repeats(rows, 287)


def test_hot_windows_have_two_hashes():
    """A Thue-Morse string and its complement meet in any polynomial hash modulo 2**64; the second hash tells them apart."""
    a = bytes(97 + i.bit_count() % 2 for i in range(2048))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    part = pa.RecordBatch.from_pydict({"name": [1, 1, 1], "n": [1, 1, 1], "id": [1, 2, 3], "place": [0, 0, 0], "bytes": pa.array([a, b, a], pa.binary())})
    (out,) = window_rows_of(2048)(iter([part]))
    h1, h2 = out["h1"].to_pylist(), out["h2"].to_pylist()
    assert h1[0] == h1[1] == h1[2]
    assert h2[0] == h2[2] != h2[1]


def test_repeats_empty(empty):
    assert suffix_dedup(empty).collect() == []
