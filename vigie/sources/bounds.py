"""Largest value of a column from file metadata alone.

Parquet keeps the bounds of every column chunk in a file's footer, so the
latest date of a panel needs no data page: the maximum is pushed down to the
footers for dates and whole numbers. Files without bounds, and other types
(Spark pushes no timestamps down), are read by the usual aggregate over the one
column.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_max(spark: SparkSession, path: str, schema: T.StructType | str, col: str) -> DataFrame:
    """One row, ``largest``: the maximum of ``col`` over the Parquet files at ``path``, pushed down to their footers."""
    aside = spark.newSession()  # the reader that pushes aggregates down is chosen per session
    aside.conf.set("spark.sql.sources.useV1SourceList", "")
    aside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return aside.read.schema(schema).parquet(path).agg(F.max(F.col(f"`{col}`")).alias("largest"))


def largest(spark: SparkSession, path: str, schema: T.StructType | str, col: str):
    """The maximum of ``col`` (NULLs skipped), None for an empty table."""
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if isinstance(declared[col].dataType, BOUNDED):
        try:
            return footer_max(spark, path, schema, col).first()[0]
        except (PySparkException, Py4JJavaError) as refused:
            # footers written without statistics, or of missing values alone
            if "No min/max found" not in str(refused):
                raise
    return spark.read.schema(schema).parquet(path).agg(F.max(F.col(f"`{col}`"))).first()[0]
