"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: rows are grouped by (digest, salt, text); Spark's partial aggregation
   deduplicates inside each map task before anything is shuffled, and the salt
   spreads the copies of one text over many reducers.
2. Global: the salts' winners are grouped by (digest, text).

Both stages group by the full text, so that content is compared, not only its
digest. The winners are then brought to the rows by digest; should two
different texts ever share a SHA-256 digest, the query fails instead of
returning a wrong class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, salt

SALTS = 64


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as the
    empty text. Of equal texts the row with the largest id stays; rows that
    repeat both id and text are each counted, and kept together. A NULL id is
    kept only when its whole group has NULL ids. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn(
        "digest", F.sha2(F.col("norm").cast("binary"), 256)
    )
    local = rows.groupBy("digest", salt(F.col("id"), salts).alias("salt"), "norm").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    winners = local.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    classes = winners.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    checked = classes.select(
        F.unhex("digest").alias("key"),
        "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
        .alias("group_size"),
    )
    # Keyed by the digest's bytes, each side gets an exchange of its own, which
    # adaptive execution can split where one digest holds many rows.
    members = rows.select("id", F.unhex("digest").alias("key"))
    return members.join(checked, "key").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )
