"""Fill-in-the-middle against a brute-force version, and the exact round trip."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigie.llm.fill_in_middle import MARKERS, check_markers, fill_in_middle, fim_report, rebuild

from .conftest import CLASHING, edge_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80, markers=MARKERS):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = markers
    if text == "" or any(x in text for x in markers) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def outputs(df, **options):
    out = fill_in_middle(df, **options)
    cols = [out["doc_id"], *[F.col(f"fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars", "output")]]
    return sorted(map(tuple, out.select(*cols).collect()), key=str)


def test_edges(spark, edge, empty):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert outputs(edge) == sorted((brute(*r) for r in rows), key=str)
    assert outputs(edge, rate=100) == sorted((brute(*r, rate=100) for r in rows), key=str)
    assert set(CLASHING) <= set(fill_in_middle(edge).columns)
    assert fim_report(empty).count() == 0 and fill_in_middle(edge.withColumns({c: F.lit(1) for c in ("a", "b", "row", "form", "fim")})).count() == len(rows)


pieces = st.sampled_from([" ", "\n", "\t\v", "a", "word", "é", "🎉", "<", "<P", "P>", "<M", "<S>", "$1", "\\", " ", "{2}"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pieces, max_size=30).map("".join), min_size=1, max_size=30), st.integers(0, 99))
def test_round_trip(spark, texts, seed):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for markers in (MARKERS, ("[pre$1]", "[suf\\]", "[mid]")):
        got = outputs(df, seed=seed, rate=100, spm_rate=50, markers=markers)
        assert got == sorted((brute(i, t, seed, 100, 50, markers) for i, t in enumerate(texts)), key=str)
        back = fill_in_middle(df, seed=seed, rate=100, spm_rate=50, markers=markers).select(
            "doc_id", "text", rebuild(F.col("fim.output"), F.col("fim.form"), markers).alias("back")).collect()
        assert all(r["text"] == r["back"] for r in back)


def test_long_texts(spark):
    rows = [(i + 10 * k, t) for k in range(4) for i, t in enumerate(["a b\n" * 300_000, " " * 1_000_000, "x" * 1_000_000, "é 🎉 " * 200_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert outputs(df, rate=100) == sorted((brute(i, t, rate=100) for i, t in rows), key=str)


def test_plan_is_native_and_does_not_shuffle(spark, docs):
    plan = fim_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("<P>", "x<P>", "<M>"), ("ab", "bc", "d"), ("<P>", "<S>")])
def test_markers_that_overlap_are_refused(markers):
    with pytest.raises(ValueError):
        check_markers(markers)
