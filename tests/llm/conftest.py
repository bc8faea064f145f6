import random

import pytest

SF = "/root/testdata/sf0.001"
CLASHING = ["id", "size", "h", "n", "token", "shard", "row", "digest", "keep_id", "component", "bucket", "skey", "text_sha256", "score", "x", "k1"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("the", "of", "und", "word")) + rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n))


def edge_rows():
    """NULLs, empty and blank texts, ties, repeated rows, near copies, one long text, shared passages."""
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 70)
    near = base[0].split()
    near[60] = "CHANGED"
    texts = [None, "", "  \n\t ", "one", "One", "two words", "three little words", base[0], base[0].upper(), " ".join(near),
             base[1], base[1], base[1] + " tail", passage + "\n" + base[2], base[3] + "\n" + passage, "é" * 90 + passage, "É",
             "é", prose(rng, 6000), "aa " * 400, "…", "Licensed under the Apache License, Version 2.0.\ncc by", "mit license MIT  license"]
    sources = ["s1", "s2", None, "ß", "S"]
    rows = [(i, t, ["en", "de", None][i % 3], sources[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, "null id", None, None, 7), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
