"""Column functions against the micro-fixtures of FIXTURES.md section 4 and the Q rules."""

import datetime as dt
import math

from pyspark.sql import functions as F

from vigie import functions as V

from .conftest import rows


def _one(spark, data, schema, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_strict_and_lenient_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("c", None)], "k string, x long")
    out = dict(df.groupBy("k").agg(V.strict_sum("x").alias("s")).collect())
    assert out == {"a": None, "b": 2, "c": None}
    lenient = dict(df.groupBy("k").agg(V.na_sum("x").alias("s")).collect())
    assert lenient == {"a": 1, "b": 2, "c": 0}


def test_strict_sum_over_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, x long")
    w = Window.partitionBy("k")
    out = sorted((r.k, r.s) for r in df.select("k", V.strict_sum("x", w).alias("s")).collect())
    assert out == [("a", None), ("a", None), ("b", 2)]


def test_safe_ratio_and_r_divide(spark):
    data = [(0.0, 0.0), (3.0, 0.0), (1.0, 4.0), (None, 2.0), (-3.0, 0.0)]
    df = spark.createDataFrame(data, "a double, b double")
    safe = [r[0] for r in df.select(V.safe_ratio("a", "b")).collect()]
    assert safe[0] == 0.0 and safe[1] == math.inf and safe[2] == 0.25 and safe[3] is None
    assert safe[4] == -math.inf
    raw = [r[0] for r in df.select(V.r_divide("a", "b")).collect()]
    assert math.isnan(raw[0]) and raw[1] == math.inf


def test_pct_change_zero_base_follows_division(spark):
    out = _one(spark, [(110.0, 100.0), (5.0, 0.0)], "a double, b double", V.pct_change("a", "b"))
    assert out[0] == (110.0 - 100.0) / 100.0 * 100.0 and out[1] == float("inf")


def test_present_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert [r.x for r in df.where(V.present("x")).collect()] == [1.0]


def test_round_even_ties_and_specials(spark):
    out = _one(spark, [(0.5,), (1.5,), (2.5,), (-0.5,), (None,)], "x double", V.round_even("x"))
    assert out == [0.0, 2.0, 2.0, -0.0, None]
    assert _one(spark, [(0.15,), (0.25,)], "x double", V.round_even("x", 1)) == [0.1, 0.2]
    assert _one(spark, [(2.675,), (1.005,), (1.015,), (0.125,)], "x double", V.round_even("x", 2)) == [2.67, 1.0, 1.01, 0.12]
    sp = _one(spark, [(float("inf"),), (float("nan"),)], "x double", V.round_even("x", 1))
    assert sp[0] == math.inf and math.isnan(sp[1])


def test_pad_left_never_truncates(spark):
    out = _one(spark, [("1",), ("22",), ("971",), ("2A",)], "s string", V.pad_left("s", 2))
    assert out == ["01", "22", "971", "2A"]


def test_recode_keep_and_drop(spark):
    m = {"9A": "971", "9F": "976"}
    assert _one(spark, [("9A",), ("9F",), ("29",)], "s string", V.recode("s", m)) == ["971", "976", "29"]
    assert _one(spark, [("9A",), ("29",)], "s string", V.recode("s", m, keep=False)) == ["971", None]


def test_classify_left_closed(spark):
    data = [(4.9,), (5.0,), (10.0,), (None,), (float("nan",),), (float("inf"),)]
    out = _one(spark, data, "x double", V.classify("x", (5, 10)))
    assert out == ["vert", "orange", "rouge", None, None, "rouge"]


def test_classify_right_closed(spark):
    out = _one(spark, [(6.0,), (10.0,), (10.1,)], "x double", V.classify("x", (6, 10), closed="right"))
    assert out == ["vert", "orange", "rouge"]


def test_relabel(spark):
    out = _one(spark, [("vert",), ("bleu",)], "c string", V.relabel("c", {"vert": "sous 1"}))
    assert out == ["sous 1", None]


def test_month_labels_fr(spark):
    data = [(dt.date(2020, 7, 24),), (dt.date(2020, 8, 1),)]
    assert _one(spark, data, "d date", V.month_label("d")) == ["24 juillet", "01 août"]
    assert _one(spark, data, "d date", V.month_label("d", short=True)) == ["24 juil.", "01 août"]


def test_day_month_formats_and_stamp(spark):
    data = [(dt.date(2020, 3, 5),)]
    assert _one(spark, data, "d date", V.day_month("d")) == ["05/03"]
    assert _one(spark, data, "d date", V.day_month_year("d")) == ["05/03/2020"]
    assert _one(spark, data, "d date", V.stamp(V.as_of_or_now("2020-07-24 09:30:00"))) == ["24 juillet, 09h"]


def test_number_text(spark):
    data = [(1.0,), (1.1,), (0.03,), (12.5,), (None,), (float("nan"),), (float("inf"),)]
    assert _one(spark, data, "x double", V.number_text("x")) == ["1", "1.1", "0.03", "12.5", None, "NaN", "Inf"]
    # as R's as.character: 15 significant digits, scientific only when shorter
    data = [(100000.0,), (123456.0,), (0.0001,), (0.001,), (1 / 3,), (0.1 + 0.2,), (-2.5,), (1.23e-7,)]
    assert _one(spark, data, "x double", V.number_text("x")) == [
        "1e+05", "123456", "1e-04", "0.001", "0.333333333333333", "0.3", "-2.5", "1.23e-07"]


def test_sentence_and_join_text_null_propagates(spark):
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert df.select(V.sentence("<", F.col("x"), F.col("y"))).first()[0] is None
    assert df.select(V.join_text("/", F.col("x"), F.col("y"))).first()[0] is None
    assert df.select(V.join_text("/", F.col("x"), F.col("z"), "c")).first()[0] == "a/b/c"


def test_substring_between_and_parse_date(spark):
    df = spark.createDataFrame([("2020-04-06",), ("not a date",)], "s string")
    assert [r[0] for r in df.select(V.substring_between("s", 9, 10)).collect()] == ["06", "te"]
    assert [r[0] for r in df.select(V.parse_date("s")).collect()] == [dt.date(2020, 4, 6), None]


def test_fill(spark):
    assert _one(spark, [(None,), (3,)], "x long", V.fill("x", 0)) == [0, 3]


def test_encode_repair(spark):
    broken = "Ã©"  # "é" read as Latin-1
    assert _one(spark, [(broken,)], "s string", V.encode_repair("s")) == ["é"]


def test_rows_helper_orders_nulls_first(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x long")
    assert rows(df) == [(None,), (1,), (2,)]


def test_parse_day_month_keeps_a_full_date(spark):
    out = _one(spark, [("06/04",), ("29/02",), ("31/02",)], "s string", V.parse_day_month("s", 2020))
    assert out == [dt.date(2020, 4, 6), dt.date(2020, 2, 29), None]


def test_round_even_large_values_do_not_overflow(spark):
    out = _one(spark, [(123456789012345.5,), (-2.5e13,), (999999999999.5,)], "x double", V.round_even("x"))
    assert out == [123456789012346.0, -2.5e13, 1000000000000.0]


def test_classify_refuses_unsorted_cuts():
    import pytest

    with pytest.raises(ValueError):
        V.classify("x", (10, 5))


def test_r_divide_nan_over_zero_is_nan(spark):
    out = _one(spark, [(float("nan"), 0.0), (float("nan"), 2.0)], "a double, b double", V.r_divide("a", "b"))
    assert math.isnan(out[0]) and math.isnan(out[1])


def test_round_even_is_exact_beyond_six_decimals(spark):
    for x, digits, want in ((0.5000004, 0, 1.0), (2.5000001, 0, 3.0), (1.0050003, 2, 1.01), (0.2500004, 1, 0.3), (0.123456789, 8, 0.12345679)):
        assert _one(spark, [(x,)], "x double", V.round_even("x", digits)) == [want]


def test_nan_is_missing_for_fill_and_na_sum(spark):
    nan = float("nan")
    assert _one(spark, [(nan,), (None,), (2.0,)], "x double", V.fill("x")) == [0.0, 0.0, 2.0]
    df = spark.createDataFrame([(1.0,), (nan,), (None,)], "x double")
    assert df.agg(V.na_sum("x")).first()[0] == 1.0


def test_encode_repair_decides_by_value(spark):
    broken = lambda t: t.encode().decode("latin-1")
    texts = ["é", "été à Noël", "plain", "", None, "10 €", "ÿ", "…", "a\nß"]
    data = [(t,) for t in texts] + [(None if t is None else broken(t),) for t in texts]
    assert _one(spark, data, "s string", V.encode_repair("s")) == texts * 2
