"""Rows that share an id, or have none, are judged each on its own text."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from vigie.llm import near_dedup as N
from vigie.llm.decontamination import remove_documents, remove_spans
from vigie.llm.language_id import train as train_language
from vigie.llm.license_scan import TEMPLATES, license_scan
from vigie.llm.mixing import mix
from vigie.llm.quality import train as train_quality
from vigie.llm.suffix_dedup import suffix_dedup

from .conftest import SCHEMA, prose
from .test_pairs import brute_repeats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 60)) + (" " + passage if k % 50 == 0 else "") for k in range(1200)]
    texts += [TEMPLATES["notice-mit"] if "notice-mit" in TEMPLATES else next(iter(TEMPLATES.values())), "plain", None, "", "mit license", "x" * 500, "x" * 500]
    # a thousand rows without an id, the others with a few that repeat
    return [(None if k < 1000 else k % 7, t, "en", "ab"[k % 2], 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def both(spark, rows):
    own = [(k, *r[1:]) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(own, SCHEMA)


def without_id(df):
    return Counter(tuple(r)[1:] for r in df.collect())


def test_repeated_strings(both, rows):
    assert sorted(map(tuple, suffix_dedup(both[0]).collect()), key=str) == brute_repeats([(r[0], r[1]) for r in rows])


def test_licences(both):
    got = without_id(license_scan(both[0], wrapped=True))
    assert got == without_id(license_scan(both[1], wrapped=True))
    assert sum(n for r, n in got.items() if r[-1] > 0) == 2


def test_pipeline_keeps_one_row_of_each_group(spark):
    t, t2 = prose(random.Random(1), 80), prose(random.Random(2), 80)
    near = t + " tail"
    for given, want in (
        ([(5, t), (5, t), (None, t), (None, t), (7, t)], [(5, t)]),
        ([(5, t), (9, t), (9, t2)], [(5, t), (9, t2)]),
        ([(None, near), (None, t), (None, t2), (None, None), (None, None), (3, "")], [(None, None), (None, None), (None, t2), (3, "")]),
    ):
        df = spark.createDataFrame([(i, x, None, None, 0) for i, x in given], SCHEMA)
        kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, df, "").collect()]
        if len(want) == 4:  # either of the two near copies without an id
            assert len([k for k in kept if k[1] in (t, near)]) == 1
            kept = [k for k in kept if k[1] not in (t, near)]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_pipeline_mixes_rows(spark, rows):
    df = spark.createDataFrame([(None if k % 3 else k // 3 % 5, *r[1:]) for k, r in enumerate(rows)], SCHEMA)
    words = lambda t: len((t or "").split())
    got = P.mixing(spark, df, "").collect()
    taken = Counter(r["source"] for r in got for _ in range(words(r["text"])))
    plan = mix(df).collect()
    assert sum(taken.values()) == sum(r["taken"] for r in plan)
    for source in "ab":
        target = {r["target"] for r in plan if r["source_size"] == sum(words(x[1]) for x in rows if x[3] == source)}
        assert any(abs(taken[source] - t) < 60 for t in target)
    assert max(Counter((r["doc_id"], r["text"]) for r in got).values()) <= 2 * max(Counter((r["doc_id"], r["text"]) for r in df.collect()).values())


def test_samples_are_bounded_whatever_the_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 39, prose(random.Random(k), 20), ("en", "fr")[k % 2], "s", 0) for k in range(4000)], SCHEMA)
    model = train_language(docs, train_rows=50)
    assert model["langs"] == ["en", "fr"]
    labels = spark.createDataFrame([(k, k % 2) for k in range(39)], "doc_id long, quality long")
    seen = []
    from vigie.llm import quality as Q

    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append(len(y)) or {})
    train_quality(docs, labels, train_rows=10)
    assert seen == [10]


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "some clean words", "h", "k"), (2, "mit", "b", "o")], "doc_id long, text string, __text string, own string")
    bench = spark.createDataFrame([(1, "mit"), (2, "other words of it")], "item_id long, text string")
    for options in ({}, {"block_words": 2}):
        assert remove_documents(df, bench, **options).collect() == df.where("doc_id = 1").collect()
        assert remove_spans(df, bench, **options).columns == df.columns


def near_copies(n, seed=3):
    """Copies of one text of 60 words, two of them changed in each."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(60)] = f"c{rng.randrange(5000)}"
        out.append((k, " ".join(words)))
    return out


def test_pairs_of_a_group_grow_with_its_size(spark, monkeypatch):
    counts = []
    original = N.confirmed

    def counting(pairs, *rest):
        counts[-1].append(pairs.count())
        return original(pairs, *rest)

    monkeypatch.setattr(N, "confirmed", counting)
    for n in (300, 1200):
        counts.append([])
        N.near_dedup(spark.createDataFrame(near_copies(n), "doc_id long, text string"), shingle=5)
    few, many = counts
    assert len(few) == len(many) == N.ROUNDS + 1
    # four times the texts: about four times the pairs in every round, not sixteen
    assert all(b <= 6 * a + 400 for a, b in zip(few, many)), counts
