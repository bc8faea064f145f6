"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id reachable.

    Each step is a join and a partial aggregate; the edge table is written to
    the shared folder after each round, so the rounds build no long lineage.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(state)
    while True:
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        star = large.join(least, F.col("a") == F.col("u"))
        small = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state = cut(small.distinct())
        mark, before = _mark(state), mark
        if mark == before:
            roots = state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
