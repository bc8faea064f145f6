"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words of runs that are not ASCII white space / not ASCII non-alphanumerics.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same and faster where the text is pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


RUN = uuid.uuid4().hex[:12]


def run_dir(spark: SparkSession) -> str:
    """This process's folder of written tables."""
    return f"{scratch_dir(spark).rstrip('/')}/vigie-llm-{RUN}"


def remove_run(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` wrote, once the results that read them are written."""
    remove_folder(spark, run_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing
    the table, and a join on the result starts from unpartitioned files, so
    that adaptive execution can split skewed keys on both of its sides.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row as ``name``, the same every time the result is read.

    Ids that repeat or are missing cannot tell rows apart; a row's place can,
    as long as each reading finds the rows in the same order. A scan of files
    does; behind a shuffle the order may depend on the columns asked for, so
    such a table is written first.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = df.withColumn(name, F.monotonically_increasing_id())
    return cut(out) if "Exchange" in plan else out


def salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
