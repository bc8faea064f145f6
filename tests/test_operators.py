"""DataFrame operators: panels, joins, totals, reshapes, aggregates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigie import operators as O
from vigie.functions import strict_sum

from .conftest import rows

D = dt.date


def test_keep_present(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id int, x double")
    assert rows(O.keep_present(df, "x"), "id") == [(1,)]


def test_latest_is_a_scalar_subquery_not_a_window(spark):
    df = spark.createDataFrame([(D(2020, 7, 23), 1), (D(2020, 7, 24), 2), (D(2020, 7, 24), 3)], "d date, v int")
    out = O.latest(df, "d")
    assert rows(out, "v") == [(2,), (3,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "Window" not in plan


def test_trailing_days_f7_vs_f8(spark):
    # Last day (07-24) only has sexe 1: F8 (max over all rows) keeps 6 days of
    # sexe 0, F7 (max after the sexe filter) keeps 7.
    data = [("0", D(2020, 7, 16) + dt.timedelta(days=i)) for i in range(8)] + [("1", D(2020, 7, 24))]
    df = spark.createDataFrame(data, "sexe string, d date")
    total = df.where(F.col("sexe") == "0")
    f8 = O.trailing_days(total, "d", 7, anchor=df)
    f7 = O.trailing_days(total, "d", 7)
    assert f8.count() == 6
    assert rows(f7, "d") == [(D(2020, 7, 17) + dt.timedelta(days=i),) for i in range(7)]


def test_trailing_days_window_bounds(spark):
    df = spark.createDataFrame([(D(2020, 7, 24) - dt.timedelta(days=i),) for i in range(10)], "d date")
    kept = rows(O.trailing_days(df, "d", 7))
    assert kept[0] == (D(2020, 7, 18),) and kept[-1] == (D(2020, 7, 24),) and len(kept) == 7


def test_join_on_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(O.join_on(left, right, ["k"], "left")) == [(None, 1, None), ("a", 2, 20)]
    assert rows(O.join_on(left, right, ["k"], "left", na_matches="na")) == [(None, 1, 10), ("a", 2, 20)]


def test_join_on_right_keeps_right_key_under_left_name(spark):
    stats = spark.createDataFrame([("01", 5.0)], "code_dep string, v double")
    geo = spark.createDataFrame([("01", "g1"), ("02", "g2")], "insee_dep string, geometry string")
    out = O.on_geography(stats, geo, "code_dep", "insee_dep")
    assert out.columns == ["code_dep", "v", "geometry"]
    assert rows(out) == [("01", 5.0, "g1"), ("02", None, "g2")]
    left = O.on_geography(stats, geo, "code_dep", "insee_dep", how="left")
    assert left.columns == ["insee_dep", "geometry", "v"]


def test_join_on_two_keys_full(spark):
    a = spark.createDataFrame([("d1", "x", 1)], "d string, k string, a int")
    b = spark.createDataFrame([("d2", "x", 2)], "d string, k string, b int")
    out = O.join_on(a, b, ["d", "k"], "full")
    assert rows(out) == [("d1", "x", 1, None), ("d2", "x", None, 2)]


def test_with_group_totals_null_group_and_overwrite(spark):
    df = spark.createDataFrame(
        [("01", "r1", 2.0, 10), ("02", "r1", 3.0, None), ("03", None, 4.0, None), ("04", "r2", 1.0, 5)],
        "dep string, reg string, rea double, lits long")
    out = O.with_group_totals(df, ["reg"], {"rea": strict_sum("rea"), "lits": strict_sum("lits")})
    got = {r.dep: (r.reg, r.rea, r.lits) for r in out.collect()}
    assert got == {"01": ("r1", 5.0, None), "02": ("r1", 5.0, None), "03": (None, 4.0, None), "04": ("r2", 1.0, 5)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_append_total_members_differ_from_detail(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 4)], "day int, dep string, x long")
    out = O.append_total(df, df.where(F.col("dep") != "c"), ["day"], ["x"], "dep", "TOTAL")
    assert rows(out, "dep", "x") == [("TOTAL", 3), ("a", 1), ("b", 2), ("c", 4)]


def test_decumulate_lag(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 15, 15, 22])], "d int, total long")
    out = O.decumulate(df, {"daily": "total"}, "d")
    assert [r.daily for r in out.orderBy("d").collect()] == [None, 5, 0, 7]


def test_decumulate_partitioned(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 4), ("b", 1, 2), ("b", 2, 2)], "k string, d int, t long")
    out = O.decumulate(df, {"x": "t"}, "d", ["k"])
    assert rows(out, "k", "d", "x") == [("a", 1, None), ("a", 2, 3), ("b", 1, None), ("b", 2, 0)]


def test_pivot_wide_and_duplicate_error(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)], "d int, reg string, r double")
    out = O.pivot_wide(df, ["d"], "reg", "r", ["A", "B"])
    assert rows(out) == [(1, 1.0, 2.0), (2, 3.0, None)]
    dup = df.union(spark.createDataFrame([(1, "A", 9.0)], df.schema))
    with pytest.raises(Exception, match="several values"):
        O.pivot_wide(dup, ["d"], "reg", "r", ["A", "B"]).collect()


def test_pivot_wide_discovers_names(spark):
    df = spark.createDataFrame([(1, "B", 1.0), (2, "A", 3.0)], "d int, reg string, r double")
    out = O.pivot_wide(df, ["d"], "reg", "r", None)
    assert out.columns == ["d", "A", "B"] and rows(out) == [(1, None, 1.0), (2, 3.0, None)]


def test_unpivot_pivot_round_trip_keeps_nulls(spark):
    wide = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "d int, A double, B double")
    long = O.unpivot_long(wide, ["d"], names_to="reg", values_to="r")
    assert long.count() == 4
    back = O.pivot_wide(long, ["d"], "reg", "r", ["A", "B"])
    assert rows(back) == rows(wide)


def test_transpose(spark):
    df = spark.createDataFrame([("0-9", 1.0, 2.0), ("10-19", 3.0, 4.0)], "age string, d1 double, d2 double")
    t = O.transpose(df, "age", "date", ["0-9", "10-19"])
    assert rows(t) == [("d1", 1.0, 3.0), ("d2", 2.0, 4.0)]


def test_unnest(spark):
    df = spark.createDataFrame([(1, [(D(2020, 4, 6),), (D(2020, 4, 5),)])], "id int, jour array<struct<d:date>>")
    assert rows(O.unnest(df, "jour")) == [(1, D(2020, 4, 5)), (1, D(2020, 4, 6))]


def test_select_at_and_mutate_typed(spark):
    df = spark.createDataFrame([("x", 1.26, 3, D(2020, 1, 2))], "a string, b double, c long, d date")
    assert O.select_at(df, 1, 3).columns == ["a", "c"]
    from pyspark.sql import types as T

    from vigie.functions import round_even, to_text

    out = O.mutate_typed(df, (T.DoubleType,), lambda c: round_even(c, 1))
    out = O.mutate_typed(out, (T.DateType,), to_text)
    assert out.first().asDict() == {"a": "x", "b": 1.3, "c": 3, "d": "2020-01-02"}
    assert O.mutate_all(df.select("c"), to_text).first()[0] == "3"


def test_mutate_is_sequential(spark):
    df = spark.createDataFrame([(2,)], "x long")
    out = O.mutate(df, x=F.col("x") * 10, y=F.col("x") + 1)
    assert out.first().asDict() == {"x": 20, "y": 21}


def test_rename_and_select_as(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert O.rename(df, {"z": "a"}).columns == ["z", "b"]
    assert O.select_as(df, {"y": "b", "a": "a"}).columns == ["y", "a"]


def test_grouped_sums_and_fixed_mean(spark):
    df = spark.createDataFrame([("a", 7), ("a", None), ("b", 14), ("b", 3)], "k string, x long")
    assert rows(O.grouped_sums(df, ["k"], ["x"])) == [("a", None), ("b", 17)]
    assert rows(O.grouped_sums(df, ["k"], ["x"], na_rm=True)) == [("a", 7), ("b", 17)]
    # mean over a fixed 7-day window, rounded half to even: 17 / 7 = 2.43 -> 2
    assert rows(O.fixed_window_mean(df.where(F.col("k") == "b"), ["k"], "x", 7, "m")) == [("b", 2.0)]


def test_peak_earliest_on_ties(spark):
    df = spark.createDataFrame([(D(2020, 3, 1), 5.0), (D(2020, 4, 1), 9.0), (D(2020, 5, 1), 9.0),
                                (D(2020, 7, 24), 1.0)], "d date, v double")
    r = O.peak(df, "d", "v").first()
    assert (r.peak_value, r.peak_date, r.last_date, r.last_label) == (9.0, D(2020, 4, 1), D(2020, 7, 24), "24 juil.")


def test_assert_unique(spark):
    ok = spark.createDataFrame([("r1", "01", 3), ("r1", None, 1)], "reg string, dep string, lits long")
    assert O.assert_unique(ok, ["dep"]).count() == 2
    dup = ok.union(spark.createDataFrame([("r2", "01", 5)], ok.schema))
    with pytest.raises(Exception, match="duplicate"):
        O.assert_unique(dup, ["dep"], "department").collect()


def test_join_on_keeps_same_named_columns_with_suffixes(spark):
    a = spark.createDataFrame([("k1", 1)], "k string, v int")
    b = spark.createDataFrame([("k1", 2)], "k string, v int")
    out = O.join_on(a, b, ["k"], "left")
    assert out.columns == ["k", "v.x", "v.y"] and tuple(out.first()) == ("k1", 1, 2)


def test_keep_present_on_text_and_dates(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), (None, None), ("NaN", D(2020, 1, 2))], "s string, d date")
    assert rows(O.keep_present(df, "s", "d"), "s") == [("NaN",), ("a",)]


def test_peak_skips_missing_values(spark):
    df = spark.createDataFrame([("2020-01-01", None), ("2020-01-02", 5.0), ("2020-01-03", float("nan")), ("2020-01-04", 5.0)],
                               "d string, v double").selectExpr("CAST(d AS DATE) d", "v")
    r = O.peak(df, "d", "v").first()
    assert (r.peak_value, str(r.peak_date), str(r.last_date)) == (5.0, "2020-01-02", "2020-01-04")


def test_pivot_wide_refuses_an_unlisted_label(spark):
    import pytest

    df = spark.createDataFrame([(1, "A", 1.0), (2, "C", 2.0), (3, None, 3.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="label not listed: C"):
        O.pivot_wide(df, ["id"], "k", "v", ["A", "B"]).collect()
    assert O.pivot_wide(df.where("id <> 2"), ["id"], "k", "v", ["A", "B"]).count() == 2


def test_select_at_refuses_positions_outside(spark):
    import pytest

    for i in (0, 3, -1):
        with pytest.raises(ValueError):
            O.select_at(spark.range(1).selectExpr("id a", "id b"), i)


def test_joins_match_missing_keys_by_default(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert {tuple(r) for r in O.with_comparator(left, right, "k").collect()} == {(None, 1, 10), ("a", 2, 20)}
    assert {tuple(r) for r in O.with_comparator(left, right, "k", na_matches="never").collect()} == {(None, 1, None), ("a", 2, 20)}


def test_pivot_map(spark):
    df = spark.createDataFrame([(1, "B", 1.0), (1, "A", None), (2, "A", 3.0), (3, None, 4.0)], "d int, reg string, r double")
    wide = O.pivot_map(df, ["d"], "reg", "r")
    assert {r.d: list(r.cells.items()) for r in wide.collect()} == {1: [("A", None), ("B", 1.0)], 2: [("A", 3.0)], 3: []}
    assert sorted(map(tuple, O.unpivot_map(wide, names_to="reg", values_to="r").collect()), key=str) == sorted([(1, "A", None), (1, "B", 1.0), (2, "A", 3.0)], key=str)
    many = spark.range(30_000).select((F.col("id") % 2).alias("d"), F.concat(F.lit("c"), "id").alias("reg"), F.col("id").alias("r"))
    assert sorted(r.n for r in O.pivot_map(many, ["d"], "reg", "r").select(F.size("cells").alias("n")).collect()) == [15_000, 15_000]
    with pytest.raises(Exception, match="several values"):
        O.pivot_map(df.union(spark.createDataFrame([(1, "A", 9.0)], df.schema)), ["d"], "reg", "r").collect()
