"""Corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. The stages before the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigie.llm.decontamination import remove_documents
from vigie.llm.mixing import mix
from vigie.llm.near_dedup import near_dedup
from vigie.llm.quality import keep_good
from vigie.llm.sharding import shard
from vigie.llm.shared import cut, numbered, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE = 5  # words; pairs of similarity 0.8 or more are linked


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, which repeated and missing ids cannot stand for, and that column's name."""
    name = "_".join(["row", *docs.columns])  # no column has this name
    return numbered(docs, name), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id (a missing id is the largest)."""
    rows, number = _numbered(docs)
    groups = near_dedup(rows, id_col=number, shingle=SHINGLE).select(number, "component_id")
    ids = rows.select(number, "doc_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("number"))
    stays = groups.join(ids, number).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.number").alias(number))
    return rows.join(stays, number, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"), null_items=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    rows, number = _numbered(docs)
    copies = "_".join(["copies", number])
    taken = mix(rows, row_col=number).where("copies > 0").select(F.col("row").alias(number), F.col("copies").alias(copies))
    every = rows.join(taken, number)
    again = F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`"))).alias("_".join(["copy", number]))
    return every.select(*docs.columns, again).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows in shards of near equal bytes."""
    return shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Trained models and iterative searches have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
