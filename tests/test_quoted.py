"""Quoted line breaks: files read over many splits against Python's csv module."""

import csv
import random
import tempfile
from contextlib import contextmanager

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigie.sinks import sink_csv
from vigie.sources import scan_csv
from vigie.sources.quoted import Splits, count_quotes, quoted_records

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])
PIECES = ["a", "b c", "\n", '"', ",", "\r\n", "é", ";", "\n\n", '""', "NA", " "]


@contextmanager
def splits_of(spark, size):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size) if size >= 1 << 20 else "1")
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def folder():
    rng = random.Random(1)
    path, want = tempfile.mkdtemp(prefix="vigie-csv-"), []
    for f in range(3):
        with open(f"{path}/f {f}.csv", "w", newline="") as h:
            h.write("﻿" if f == 2 else "")
            w = csv.writer(h, lineterminator="\r\n" if f == 1 else "\n", quoting=csv.QUOTE_STRINGS if f == 0 else csv.QUOTE_ALL)
            w.writerow(["x", "id", "more", "text"])
            for i in range(120):
                # texts within a line, over some, over several splits
                text = "long\n" * 300 if i % 50 == 3 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
                w.writerow([i / 4, f * 1000 + i, "m\nm", text])
                want.append((f * 1000 + i, text, i / 4, f"f {f}.csv"))
    return path, want


@pytest.mark.parametrize("size", [700, 4001, 1 << 20])
def test_splits(spark, folder, size):
    path, want = folder
    with splits_of(spark, size):
        df = scan_csv(spark, path, SCHEMA, multi_line=True, na=("never",), mode="FAILFAST", with_file="file")
        assert sorted(map(tuple, df.collect())) == want
        found = count_quotes(spark, [path])
        assert found.crossing == (size < 1 << 20)
        assert len(found.known) > 3 or size == 1 << 20
        # only records that cross a border are shuffled
        assert ("Exchange" in quoted_records(spark, [path], found)._jdf.queryExecution().executedPlan().toString()) == found.crossing


def test_other_splits_than_counted_raise(spark, folder):
    with splits_of(spark, 700):
        df = scan_csv(spark, folder[0], SCHEMA, multi_line=True)
    with splits_of(spark, 4000), pytest.raises(Exception, match="splits are not those"):
        df.collect()


def test_headers_that_differ_raise(spark, tmpdir_path):
    for name, head in (("a", "id,text,x"), ("b", "id,x,text")):
        with open(f"{tmpdir_path}/{name}.csv", "w") as h:
            h.write(f"{head}\n1,2,3\n")
    with pytest.raises(Exception, match="the header differs"):
        scan_csv(spark, tmpdir_path, SCHEMA, multi_line=True).collect()
    assert scan_csv(spark, tmpdir_path, SCHEMA, multi_line=True, align=True).count() == 2


def test_without_a_header_and_other_encodings(spark, tmpdir_path):
    rows = [(1, 'é\n"ö"; à', 0.5), (2, "x;y", None), (3, "ñ", 2.0)]
    with open(f"{tmpdir_path}/a.csv", "w", encoding="latin-1", newline="") as h:
        csv.writer(h, delimiter=";", lineterminator="\n").writerows([(i, t, "NA" if x is None else x) for i, t, x in rows])
    with splits_of(spark, 5):
        got = scan_csv(spark, tmpdir_path, SCHEMA, sep=";", header=False, encoding="ISO-8859-1", multi_line=True, na=("NA",))
        assert sorted(map(tuple, got.collect())) == rows
    with pytest.raises(ValueError):
        scan_csv(spark, tmpdir_path, SCHEMA, encoding="UTF-16", multi_line=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), min_size=1, max_size=40), st.integers(20, 300))
def test_sink_and_scan(spark, texts, size):
    rows = [(i, None if t == "NA" else t, i / 2) for i, t in enumerate(texts)]
    folder = tempfile.mkdtemp(prefix="vigie-rt-")
    sink_csv(spark.createDataFrame(rows, SCHEMA).coalesce(2), f"{folder}/t")
    with splits_of(spark, size):
        assert sorted(map(tuple, scan_csv(spark, f"{folder}/t", SCHEMA, multi_line=True, na=("NA",), mode="FAILFAST").collect())) == rows


def test_prefix_parity():
    row = lambda file, start, odd: {"file": file, "start": start, "length": 10, "odd": odd}
    found = Splits([row("b", 0, 0), row("a", 20, 0), row("a", 0, 1), row("a", 30, 3), row("a", 10, 0), row("a", 40, 1)])
    owners = {k: v[1] for k, v in found.known.items()}
    assert owners == {("a", 0): None, ("a", 10): 0, ("a", 20): 0, ("a", 30): 0, ("a", 40): None, ("b", 0): None}
    assert found.crossing and found.files == ["a", "b"]
    assert not Splits([row("a", 0, 2), row("a", 10, 0)]).crossing


def test_empty(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as h:
        h.write("id,text,x\n")
    assert scan_csv(spark, tmpdir_path, SCHEMA, multi_line=True).count() == 0
    assert scan_csv(spark, tmpdir_path, SCHEMA, multi_line=True).select(F.lit(1)).count() == 0
