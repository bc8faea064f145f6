"""A customer holding a third of all orders: the feed derivation's sort-merge
join is split by AQE's skew handling and the results do not change."""

import os

from pyspark.sql import functions as F

from vigie.sources import standins as S

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_customer_is_split_and_results_hold(spark, tmpdir_path):
    n = 30000
    orders = spark.range(n).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("o_custkey"),
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 3 + 1).cast("int"))
        .alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.timestamp_add("DAY", (F.col("id") % 700).cast("int"), F.lit("1995-01-01").cast("timestamp_ntz"))
        .alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"))
    customer = spark.range(500).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int")
                                       .alias("c_nationkey"))
    d = os.path.join(tmpdir_path, "skewed")
    orders.write.parquet(f"{d}/orders.parquet")
    customer.write.parquet(f"{d}/customer.parquet")

    def run():
        df = S.orders_month_nation(spark, d)
        rows = sorted(df.collect())
        return rows, df._jdf.queryExecution().executedPlan().toString()

    split_rows, plan = _with_conf(spark, {**SKEW_CONF, "spark.sql.shuffle.partitions": "16"}, run)
    # the final plan's sort-merge join reads the hot partition in split pieces
    assert "SortMergeJoin" in plan and "skew=true" in plan
    plain_rows, _ = _with_conf(spark, {"spark.sql.adaptive.skewJoin.enabled": "false"}, run)
    assert split_rows == plain_rows and len(split_rows) > 0
