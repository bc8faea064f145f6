"""Row numbers and lags over the order of a whole table against sorted Python lists and Spark's window."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigie import operators as O
from vigie.operators.ordered import Ordered

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
small = st.one_of(st.none(), st.integers(-5, 5))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@SETTINGS
@given(st.lists(st.tuples(small, small), max_size=60))
def test_numbers_and_differences(spark, data):
    rows = [(i, k, v) for i, (k, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, k int, v int").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = O.with_row_number(df, ["k", "id"], "place", ties=False)
    assert sorted((r["place"], r["id"]) for r in got.collect()) == [(p + 1, r[0]) for p, r in enumerate(order)]
    want = {r[0]: None if p == 0 or r[2] is None or order[p - 1][2] is None else r[2] - order[p - 1][2] for p, r in enumerate(order)}
    changed = O.differences(df, {"change": "v"}, ["k", "id"], ties=False)
    assert changed.columns == ["id", "k", "v", "change"]
    assert {r["id"]: r["change"] for r in changed.collect()} == want


def test_hot_key_is_split_over_tasks(spark):
    # two thirds of the rows share one key
    df = spark.range(0, 30_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = Ordered(df, ["k"])
        sizes = [r["n"] for r in held._per_partition()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
    numbered = held.numbered("n")
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 30_000, 30_000)
    # numbers follow the keys
    w = Window.orderBy("n")
    assert numbered.withColumn("before", F.lag("k").over(w)).where("before > k").isEmpty()


def test_no_exchange_to_one_task(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("k"), F.rand(1).alias("x"))
    for out in (O.with_row_number(df, ["k"]), O.differences(df, {"y": "x"}, ["k"]), O.decumulate(df, {"y": "x"}, "k")):
        assert "SinglePartition" not in plan(out)
        assert out.count() == 1000
    # the bounded form is the plain window
    plain = O.decumulate(df, {"y": "x"}, "k", bounded=True)
    assert "SinglePartition" in plan(plain)
    key = lambda r: r["id"]
    assert sorted(plain.collect(), key=key) == sorted(O.decumulate(df, {"y": "x"}, "k").collect(), key=key)


def test_clashing_names_and_empty(spark):
    rng = random.Random(1)
    names = ["row", "at", "part", "n", "before", "own", "carry"]
    df = spark.createDataFrame([tuple(rng.randint(0, 9) for _ in names) + (i,) for i in range(50)], ", ".join(f"{n} int" for n in names) + ", id int")
    out = O.with_row_number(df, ["row", "id"], "place", ties=False)
    assert out.columns == [*names, "id", "place"]
    order = sorted(df.collect(), key=lambda r: (r["row"], r["id"]))
    assert [tuple(r)[:-1] for r in out.orderBy("place").collect()] == [tuple(r) for r in order]
    back = Ordered(df, ["row", "id"], ties=False).lagged({"before at": "at"}).orderBy("row", "id").collect()
    assert [r["before at"] for r in back] == [None, *[r["at"] for r in order[:-1]]]
    assert O.with_row_number(df.limit(0), ["id"]).count() == 0 and O.differences(df.limit(0), {"y": "n"}, ["id"]).count() == 0
