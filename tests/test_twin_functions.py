"""The Spark column functions and their SQL twins (used by the DuckDB oracle)
agree on random values, ties, negatives, NaN and infinities."""

import math

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigie import functions as V
from vigie.plans import oracle as O

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.one_of(
    st.integers(min_value=-10**6, max_value=10**6).map(lambda n: n / 1000),   # ties at 3 decimals
    st.integers(min_value=-10**4, max_value=10**4).map(lambda n: n / 8),      # exact binary ties
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.sampled_from([float("nan"), float("inf"), float("-inf"), 0.0, -0.0]),
    st.none(),
)


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


def _duck(xs, expr_sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(xs)))
    return [r[0] for r in con.execute(f"SELECT {expr_sql} FROM t ORDER BY i").fetchall()]


def _spark(spark, xs, col):
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


@SETTINGS
@given(st.lists(values, min_size=1, max_size=25), st.integers(min_value=0, max_value=2))
def test_round_even_twin(spark, xs, digits):
    got = _spark(spark, xs, V.round_even("x", digits))
    want = _duck(xs, O.rnd("x", digits))
    assert all(_same(a, b) for a, b in zip(got, want)), list(zip(xs, got, want))


@SETTINGS
@given(st.lists(values, min_size=1, max_size=25), st.sampled_from(["left", "right"]))
def test_classify_twin(spark, xs, closed):
    got = _spark(spark, xs, V.classify("x", (1.0, 1.5), closed=closed))
    want = _duck(xs, O.classify("x", (1.0, 1.5), closed=closed))
    assert got == want, list(zip(xs, got, want))


@SETTINGS
@given(st.lists(st.one_of(st.integers(-10**4, 10**4).map(lambda n: n / 100), st.none(),
                          # at most 15 significant digits, any magnitude
                          st.tuples(st.integers(-10**15 + 1, 10**15 - 1), st.integers(-25, 25))
                          .map(lambda t: float(f"{t[0]}e{t[1]}")),
                          st.floats(min_value=-1e30, max_value=1e30),
                          st.sampled_from([float("nan"), float("inf"), 1e5, 1e-4, 1e-3])),
                min_size=1, max_size=25))
def test_number_text_twin(spark, xs):
    got = _spark(spark, xs, V.number_text("x"))
    want = _duck(xs, O.number_text("x"))
    assert got == want, list(zip(xs, got, want))


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=2000), min_size=1, max_size=25))
def test_pad_twin(spark, ns):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(ns)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(V.pad_left("s", 3)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(n)) for i, n in enumerate(ns)])
    want = [r[0] for r in con.execute(f"SELECT {O.pad('s', 3)} FROM t ORDER BY i").fetchall()]
    assert got == want


@SETTINGS
@given(st.lists(st.dates(min_value=__import__("datetime").date(1990, 1, 1),
                         max_value=__import__("datetime").date(2030, 12, 31)), min_size=1, max_size=25),
       st.booleans())
def test_month_label_twin(spark, days, short):
    df = spark.createDataFrame(list(enumerate(days)), "i int, d date")
    got = [r[0] for r in df.orderBy("i").select(V.month_label("d", short=short)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, d DATE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(days)))
    want = [r[0] for r in con.execute(f"SELECT {O.month_label('d', short=short)} FROM t ORDER BY i").fetchall()]
    assert got == want


def test_department_code_twin(spark):
    from pyspark.sql import functions as F

    from vigie.sources import standins as S

    got = [r[0] for r in spark.range(0, 30).orderBy("id").select(S._dep_code(F.col("id"))).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(f"SELECT {O.dep_code('id')} FROM range(0, 30) t(id) ORDER BY id").fetchall()]
    assert got == want and got[:3] == ["00", "01", "02"] and got[20] == "971"


small = st.one_of(st.none(), st.integers(-3, 3).map(float), st.sampled_from([0.0, float("nan")]))


@SETTINGS
@given(st.lists(st.tuples(small, small), min_size=1, max_size=25))
def test_ratio_twins(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, a DOUBLE, b DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    for spark_fn, sql_fn in ((V.r_divide, O.r_divide), (V.safe_ratio, O.safe_ratio)):
        got = [r[0] for r in df.orderBy("i").select(spark_fn("a", "b")).collect()]
        want = [r[0] for r in con.execute(f"SELECT {sql_fn('a', 'b')} FROM t ORDER BY i").fetchall()]
        assert all(_same(x, y) for x, y in zip(got, want)), list(zip(pairs, got, want))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-5, 5).map(float),
                                                            st.just(float("nan")))), min_size=1, max_size=25))
def test_strict_sum_twin(spark, data):
    from vigie.functions import na_sum, strict_sum

    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.s, r.l) for r in df.groupBy("g").agg(strict_sum("v").alias("s"), na_sum("v").alias("l")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = {g: (s, l) for g, s, l in con.execute(
        f"SELECT g, {O.strict_sum('v')}, coalesce(sum(v) FILTER (WHERE NOT isnan(v)), 0) FROM t GROUP BY g").fetchall()}
    assert set(got) == set(want)
    for g in got:
        assert _same(got[g][0], want[g][0]) and _same(float(got[g][1]), float(want[g][1])), (g, got[g], want[g])
