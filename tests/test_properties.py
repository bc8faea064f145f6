"""Property tests: the column rules against plain-Python statements of the same rules."""

import math
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigie import functions as V
from vigie import operators as O

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

doubles = st.one_of(
    st.integers(min_value=-10**7, max_value=10**7).map(lambda n: n / 1000),   # texts that end in a half
    st.integers(min_value=-10**5, max_value=10**5).map(lambda n: n / 16),     # stored halves
    st.integers(min_value=2**50, max_value=2**53).map(lambda n: n / 100),     # few bits left for a fraction
    st.floats(allow_nan=False, allow_infinity=False),
)


@SETTINGS
@given(st.lists(doubles, min_size=1, max_size=60), st.integers(min_value=0, max_value=6))
def test_round_even_is_half_even_on_the_stored_value(spark, xs, digits):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(V.round_even("x", digits)).collect()]
    # exact rational arithmetic; what rounds to nothing is a positive zero
    want = [float(Fraction(round(Fraction(x) * 10**digits), 10**digits)) for x in xs]
    assert got == want and all(math.copysign(1, x) > 0 for x in got if x == 0)


def test_round_even_refuses_digits_without_an_exact_power():
    for digits in (-1, 11):
        with pytest.raises(ValueError):
            V.round_even("x", digits)


def r_text(x):
    """15 significant digits as C rounds them, in the shorter notation."""
    if x != x or math.isinf(x) or x == 0:
        return "NaN" if x != x else "0" if x == 0 else "Inf" if x > 0 else "-Inf"
    mantissa, e = f"{abs(x):.14e}".split("e")
    digits, e = mantissa.replace(".", "").rstrip("0"), int(e)
    n = len(digits)
    fixed = digits + "0" * (e - n + 1) if e >= n - 1 else f"{digits[:e + 1]}.{digits[e + 1:]}" if e >= 0 else f"0.{'0' * (-e - 1)}{digits}"
    scientific = f"{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"
    return ("-" if x < 0 else "") + (fixed if len(fixed) <= len(scientific) else scientific)


@settings(SETTINGS, max_examples=6)
@given(st.lists(st.one_of(
    st.floats(), doubles,
    # halves between two 15-digit numbers, as texts
    st.tuples(st.integers(10**14, 10**15 - 1), st.integers(-330, 290)).map(lambda t: float(f"{t[0]}5e{t[1]}")),
    st.sampled_from([5e-324, 1.7976931348623157e308, 999999999999999.5, 99999999999999.95, 100000000000001.5, 1e22, 1e23])), min_size=40, max_size=120))
def test_number_text_is_exact_for_every_double(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(V.number_text("x")).collect()] == [r_text(x) for x in xs]


opt_int = st.one_of(st.none(), st.integers(min_value=-1000, max_value=1000))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), opt_int), min_size=1, max_size=40))
def test_strict_and_lenient_sums(spark, data):
    df = spark.createDataFrame(data, "k string, x long")
    got = {r.k: (r.s, r.l) for r in df.groupBy("k").agg(V.strict_sum("x").alias("s"),
                                                          V.na_sum("x").alias("l")).collect()}
    for k in {k for k, _ in data}:
        vals = [x for kk, x in data if kk == k]
        strict = None if any(v is None for v in vals) else sum(vals)
        lenient = sum(v for v in vals if v is not None)
        assert got[k] == (strict, lenient)


measures = st.one_of(st.none(), st.just(float("nan")), st.integers(min_value=0, max_value=200).map(lambda n: n / 10))


@SETTINGS
@given(st.lists(measures, min_size=1, max_size=30), st.sampled_from(["left", "right"]))
def test_classify_matches_case_when(spark, xs, closed):
    cuts, labels = (5.0, 10.0), ("vert", "orange", "rouge")
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(V.classify("x", cuts, labels, closed)).collect()]

    def ref(x):
        if x is None or x != x:
            return None
        below = (lambda c: x < c) if closed == "left" else (lambda c: x <= c)
        return labels[0] if below(cuts[0]) else labels[1] if below(cuts[1]) else labels[2]

    assert got == [ref(x) for x in xs]


@SETTINGS
@given(st.lists(st.text(alphabet="0123456789AB", min_size=0, max_size=4), min_size=1, max_size=20))
def test_pad_left_never_shortens(spark, codes):
    df = spark.createDataFrame([(c,) for c in codes], "s string")
    got = [r[0] for r in df.select(V.pad_left("s", 3)).collect()]
    assert got == [c.rjust(3, "0") for c in codes]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["A", "B", "C"]),
                          st.one_of(st.none(), st.integers(-50, 50).map(float))),
                min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1])))
def test_pivot_then_unpivot_gives_back_the_present_cells(spark, cells):
    long = spark.createDataFrame(cells, "d int, reg string, r double")
    wide = O.pivot_wide(long, ["d"], "reg", "r", ["A", "B", "C"])
    back = O.unpivot_long(wide, ["d"], names_to="reg", values_to="r").where("r IS NOT NULL")
    got = sorted(tuple(r) for r in back.collect())
    assert got == sorted(c for c in cells if c[2] is not None)


keys = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))


@SETTINGS
@given(st.lists(st.tuples(keys, st.integers(0, 9)), min_size=0, max_size=12),
       st.lists(st.tuples(keys, st.integers(0, 9)), min_size=0, max_size=12),
       st.sampled_from(["never", "na"]))
def test_left_join_matches_dplyr_rules(spark, left, right, na_matches):
    ldf = spark.createDataFrame(left, "k string, x int")
    rdf = spark.createDataFrame(right, "k string, y int")
    got = sorted((tuple(r) for r in O.join_on(ldf, rdf, ["k"], "left", na_matches).collect()), key=repr)

    def match(a, b):
        return (a is None and b is None) if na_matches == "na" and (a is None or b is None) else \
            (a is not None and a == b)

    want = []
    for k, x in left:
        hits = [y for rk, y in right if match(k, rk)]
        want += [(k, x, y) for y in hits] if hits else [(k, x, None)]
    assert got == sorted(want, key=repr)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 20), keys, st.one_of(st.none(), st.integers(0, 50))),
                min_size=1, max_size=20, unique_by=lambda t: t[0]))
def test_group_totals_repeat_the_group_sum(spark, data):
    from vigie.functions import strict_sum

    df = spark.createDataFrame(data, "id int, g string, v long")
    out = {r.id: r.v for r in O.with_group_totals(df, ["g"], {"v": strict_sum("v")}).collect()}
    for i, g, _ in data:
        members = [v for _, gg, v in data if gg == g]       # NULL keys form one group
        want = None if any(v is None for v in members) else sum(members)
        assert out[i] == want


@SETTINGS
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 10))
def test_trailing_days_keeps_the_last_n_days(spark, offsets, n):
    import datetime as dt

    base = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=o),) for o in offsets], "d date")
    got = sorted(r.d for r in O.trailing_days(df, "d", n).collect())
    last = base + dt.timedelta(days=max(offsets))
    assert got == sorted(base + dt.timedelta(days=o) for o in offsets
                         if base + dt.timedelta(days=o) > last - dt.timedelta(days=n))
