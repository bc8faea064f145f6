"""Row order over a whole table without a one-partition window.

A table is dealt by ranges of its order keys, each range sorted by its own
task, and checkpointed: from then on the rows of a partition stand in order and
the partitions follow each other. What crosses a border is one row per
partition - its number of rows, its last row - so row numbers are a prefix sum
over partitions added to a position within, and a lag takes the first row's
predecessor from the partition before. The driver holds that one row per
partition and no more.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition above, position within below


def _keys(df: DataFrame, order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_by]


class Ordered:
    """``df`` in the order of ``order_by``, NULLs as Spark sorts them.

    Equal keys are dealt further by a hash of the whole row, so that a key
    that holds many rows is split over tasks; their order among each other is
    the same in every run, but for rows that are equal throughout. With
    ``ties=False`` the given keys alone are used (they are known to be unique).

    Computed once, into the folder that ``spark.checkpoint.dir`` names (without
    one this raises): ranges are cut at sampled keys, and a second run could
    cut elsewhere.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column], ties: bool = True):
        checkpoint_dir(df.sparkSession)
        keys = _keys(df, order_by)
        if ties:
            keys = [*keys, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
        held = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        # rows keep their partition and their place in it from here on
        self.columns, self.schema = df.columns, df.schema
        self.rows = held.checkpoint(eager=True).select("row", F.monotonically_increasing_id().alias("at"))
        self.spark = df.sparkSession

    def _per_partition(self, *values: Column) -> list:
        """One row per partition that holds rows, in order."""
        part = F.shiftright("at", 33).alias("part")
        return sorted(self.rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *values).collect())

    def numbered(self, name: str = "n", start: int = 1) -> DataFrame:
        """All rows with their number in the order."""
        counts = self._per_partition()
        before = [0, *accumulate(r["n"] for r in counts)]
        # one row per partition of the checkpoint: bounded by the shuffle partitions, whatever the data
        offsets = F.broadcast(self.spark.createDataFrame([(r["part"], b) for r, b in zip(counts, before)], "part long, before long"))
        number = (F.col("before") + F.col("at").bitwiseAND(F.lit(IN_PARTITION)) + F.lit(start)).alias(name)
        joined = self.rows.join(offsets, F.shiftright("at", 33) == F.col("part"))
        return joined.select(*[F.col("row").getField(c).alias(c) for c in self.columns if c != name], number)

    def lagged(self, lags: dict[str, str]) -> DataFrame:
        """All rows with the value that the row before has: output name -> column.

        The window runs within a partition of the checkpoint, which is sorted and
        has the size that the ranges were cut to; its first row takes the value
        carried over from the last row of the partition before.
        """
        wanted = sorted(set(lags.values()))
        last = F.max_by(F.struct(*[F.col("row").getField(c).alias(c) for c in wanted]), "at").alias("last")
        ends = self._per_partition(last)
        fields = T.StructType([self.schema[c] for c in wanted])
        carried = [(r["part"], before["last"] if before else None) for before, r in zip([None, *ends], ends)]
        carry = F.broadcast(self.spark.createDataFrame(carried, T.StructType([T.StructField("part", T.LongType()), T.StructField("carry", fields)])))
        w = Window.partitionBy("own").orderBy("at")
        place = F.col("at").bitwiseAND(F.lit(IN_PARTITION))
        rows = self.rows.withColumn("own", F.shiftright("at", 33))
        rows = rows.withColumn("before", F.lag(F.struct(*[F.col("row").getField(c).alias(c) for c in wanted])).over(w))
        joined = rows.join(carry, F.col("own") == F.col("part"))
        previous = F.when(place == 0, F.col("carry")).otherwise(F.col("before"))
        out = [F.col("row").getField(c).alias(c) for c in self.columns if c not in lags]
        return joined.select(*out, *[previous.getField(c).alias(name) for name, c in lags.items()])


def with_row_number(df: DataFrame, order_by: Sequence[str | Column], name: str = "n", ties: bool = True) -> DataFrame:
    """``df`` with each row's number in the order (O1): ``arrange`` as a property of the rows."""
    return Ordered(df, order_by, ties).numbered(name)


def differences(df: DataFrame, cols: dict[str, str], order_by: Sequence[str | Column], ties: bool = True) -> DataFrame:
    """``x - lag(x)`` over the order of the whole table (W1): output name -> column."""
    back = {f"before {out}": c for out, c in cols.items()}
    lagged = Ordered(df, order_by, ties).lagged(back)
    named = lagged.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols],
                          *[(F.col(f"`{c}`") - F.col(f"`before {out}`")).alias(out) for out, c in cols.items()])
    return named
