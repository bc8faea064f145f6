"""One committed file: order, header, and what is visible when a job fails."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigie.sinks import sink_csv, sink_geojson
from vigie.sources import scan_csv, scan_geojson


def rows_in_parts(spark, n=500):
    # several tasks, some of them without rows
    return spark.range(0, n, numPartitions=7).select(F.col("id").alias("k"), F.concat(F.lit('a "b", '), "id").alias("t")) \
        .where("k % 7 <> 3").orderBy(F.col("k").desc()).where("k < 100 or k > 300")


@pytest.fixture(autouse=True)
def parts_stay(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("quote", ["minimal", "all"])
def test_order_and_one_header(spark, tmpdir_path, quote):
    path = f"{tmpdir_path}/table é.csv"
    df = rows_in_parts(spark)
    assert df.rdd.getNumPartitions() > 1
    sink_csv(df, path, single_file=True, quote=quote)
    assert os.path.isfile(path) and [n for n in os.listdir(tmpdir_path) if not n.endswith(".crc")] == ["table é.csv"]
    with open(path, encoding="utf-8") as h:
        lines = h.read().splitlines()
    assert lines[0] in ("k,t", '"k","t"') and [int(line.split(",")[0]) for line in lines[1:]] == [r["k"] for r in df.collect()]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    assert sorted(map(tuple, scan_csv(spark, path, schema, mode="FAILFAST").collect())) == sorted(map(tuple, df.collect()))


def test_collection_in_order(spark, tmpdir_path):
    path = f"{tmpdir_path}/layer.geojson"
    df = rows_in_parts(spark).withColumn("geometry", F.lit('{"type":"Point","coordinates":[1,2]}'))
    sink_geojson(df, path, collection=True)
    with open(path) as h:
        doc = json.load(h)
    assert [f["properties"]["k"] for f in doc["features"]] == [r["k"] for r in df.collect()]
    assert scan_geojson(spark, path, T.StructType([T.StructField("k", T.LongType())])).count() == df.count()
    sink_geojson(df.limit(0), path, collection=True)
    with open(path) as h:
        assert json.load(h)["features"] == []


def test_empty_table_is_a_header(spark, tmpdir_path):
    sink_csv(rows_in_parts(spark).limit(0), f"{tmpdir_path}/none.csv", single_file=True)
    with open(f"{tmpdir_path}/none.csv") as h:
        assert h.read() == "k,t\n"


def test_failed_job_leaves_the_earlier_file(spark, tmpdir_path):
    path = f"{tmpdir_path}/table.csv"
    sink_csv(spark.range(3), path, single_file=True)
    bad = spark.range(0, 50, numPartitions=4).select(F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sink_csv(bad, path, single_file=True)
    with open(path) as h:
        assert h.read() == "id\n0\n1\n2\n"
    assert [n for n in os.listdir(tmpdir_path) if not n.endswith(".crc")] == ["table.csv"]


def test_modes(spark, tmpdir_path):
    path = f"{tmpdir_path}/table.csv"
    sink_csv(spark.range(2), path)  # a folder of parts
    sink_csv(spark.range(3), path, single_file=True)
    sink_csv(spark.range(9), path, single_file=True, mode="ignore")
    assert os.path.isfile(path) and spark.read.option("header", True).csv(path).count() == 3
    with pytest.raises(FileExistsError):
        sink_csv(spark.range(2), path, single_file=True, mode="error")
    with pytest.raises(ValueError):
        sink_csv(spark.range(2), path, single_file=True, mode="append")
    sink_csv(spark.range(4), path, single_file=True)
    assert spark.read.option("header", True).csv(path).count() == 4
