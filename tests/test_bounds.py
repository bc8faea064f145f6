"""The largest value of a column from footers, against the usual aggregate."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vigie.sources.bounds import footer_max, largest

SCHEMA = "id bigint, day date, ts timestamp_ntz, t string, v double"


@pytest.fixture()
def path(spark, tmpdir_path):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i % 37), dt.datetime(2020, 1, 1) + dt.timedelta(seconds=7 * i), f"{i:03}", i / 2) for i in range(500)]
    spark.createDataFrame([*rows, (None,) * 5], SCHEMA).repartition(5).write.parquet(f"{tmpdir_path}/p")
    return f"{tmpdir_path}/p"


def test_maximum_of_every_type(spark, path):
    want = {"id": 499, "day": dt.date(2020, 2, 6), "ts": dt.datetime(2020, 1, 1) + dt.timedelta(seconds=7 * 499), "t": "499", "v": 249.5}
    assert {c: largest(spark, path, SCHEMA, c) for c in want} == want


def test_no_data_page_is_read(spark, path):
    for c in ("id", "day"):
        df = footer_max(spark, path, SCHEMA, c)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"PushedAggregation: [MAX({c})]" in plan
    # the caller's session keeps its reader
    assert "BatchScan" not in spark.read.parquet(path)._jdf.queryExecution().executedPlan().toString()


def test_files_without_statistics_and_empty_tables(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/bare")
    pq.write_table(pa.table({"id": [3, 9, 4]}), f"{tmpdir_path}/bare/a.parquet", write_statistics=False)
    assert largest(spark, f"{tmpdir_path}/bare", "id bigint", "id") == 9
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmpdir_path}/none")
    assert largest(spark, f"{tmpdir_path}/none", SCHEMA, "ts") is None
    spark.createDataFrame([(None,)], "id bigint").write.parquet(f"{tmpdir_path}/nulls")
    assert largest(spark, f"{tmpdir_path}/nulls", "id bigint", "id") is None
