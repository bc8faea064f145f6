"""Minimax contiguous sharding, in DataFrame operations only.

Equal texts form atomic groups, ordered by content digest. The smallest shard
capacity for which a greedy left-to-right fill needs at most ``shards`` shards
is found by binary search. The groups are cut where that greedy fill cuts, or
at the even share before it as long as the rest still fits that capacity, so
that the last shard is not left short.

The greedy check only asks "which group boundary is the last at or before byte
x", so the driver never needs the groups themselves: it holds a bounded
summary of the boundaries (at most ``summary`` points per round) and refines,
by one aggregation per round, only the stretches in which a cut can still lie.
The result is that of a search over all groups.
"""

from __future__ import annotations

import bisect
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, salt

SHARDS = 24
SALTS = 64
SUMMARY = 1 << 14
OVERHEAD = 8  # bytes counted for each row besides its text


class Boundaries:
    """Known group boundaries, and the stretches that may hide further ones."""

    def __init__(self, total: int):
        self.known = [0, total] if total else [0]
        self.hidden: list[tuple[int, int]] = [(0, total)] if total else []

    def replace(self, stretches: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> None:
        """Inside ``stretches`` keep what was found: (count, first, last) of each block."""
        inside = lambda x: any(a < x < b for a, b in stretches)
        known = {x for x in self.known if not inside(x)}
        hidden = [h for h in self.hidden if not any(a <= h[0] and h[1] <= b for a, b in stretches)]
        for n, first, last in found:
            known |= {first, last}
            if n > 2:
                hidden.append((first, last))
        self.known, self.hidden = sorted(known), sorted(hidden)

    def last_known(self, x: int) -> int:
        return self.known[bisect.bisect_right(self.known, x) - 1]

    def last_possible(self, x: int) -> int:
        i = bisect.bisect_right(self.hidden, (x, float("inf"))) - 1
        if i >= 0 and self.hidden[i][0] <= x < self.hidden[i][1]:
            return x
        return self.last_known(x)

    def fill(self, capacity: int, shards: int, last, at: int = 0) -> list[int]:
        """Greedy cuts from byte ``at`` on: where each shard of this capacity ends."""
        cuts = []
        for _ in range(shards):
            at = last(at + capacity)
            cuts.append(at)
        return cuts


def smallest(lo: int, hi: int, holds) -> int:
    """The smallest x of lo..hi for which ``holds`` (true at hi, monotone)."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(groups: DataFrame, shards: int, summary: int = SUMMARY) -> list[int]:
    """Byte positions at which the shards of the smallest feasible capacity end.

    ``groups`` has ``end_bytes`` (running total up to and with the group) and
    ``bytes``. Each round aggregates at most ``summary`` blocks.
    """
    total, largest = groups.agg(F.max("end_bytes"), F.max("bytes")).first()
    if not total:
        return [0] * shards
    lower, upper = max(-(-total // shards), largest), -(-total // shards) + largest
    marks = Boundaries(total)
    stretches = [(0, total)]
    while True:
        marks.replace(stretches, blocks(groups, stretches, summary))
        fits = smallest(lower, upper, lambda c: marks.fill(c, shards, marks.last_known)[-1] >= total)
        may = smallest(lower, fits, lambda c: marks.fill(c, shards, marks.last_possible)[-1] >= total)
        if may == fits:
            return even(marks, fits, shards, total)
        lower, upper = may, fits
        spans = zip(marks.fill(may, shards, marks.last_known), marks.fill(fits, shards, marks.last_possible), strict=True)
        need = sorted((a, b) for a, b in spans if a < b)
        stretches = []
        for a, b in need:
            b = marks.known[min(bisect.bisect_left(marks.known, b), len(marks.known) - 1)]
            a = marks.last_known(a)
            if stretches and a <= stretches[-1][1]:
                stretches[-1] = (stretches[-1][0], max(b, stretches[-1][1]))
            else:
                stretches.append((a, b))


def even(marks: Boundaries, capacity: int, shards: int, total: int) -> list[int]:
    """Cuts for a feasible capacity: each at the last known boundary before its even share, where the rest
    still fits; else where the greedy fill cuts. No shard exceeds the capacity."""
    cuts, at = [], 0
    for j in range(1, shards + 1):
        greedy = marks.last_known(at + capacity)
        share = max(at, marks.last_known(min(total * j // shards, at + capacity)))
        rest = shards - j
        at = share if (marks.fill(capacity, rest, marks.last_known, share) or [share])[-1] >= total else greedy
        cuts.append(at)
    return cuts


def blocks(groups: DataFrame, stretches: list[tuple[int, int]], summary: int) -> list[tuple[int, int, int]]:
    """(count, first, last) boundary of each block; a stretch strictly between its ends is cut into equal blocks."""
    each = max(2, summary // len(stretches))
    end = F.col("end_bytes")
    block: Column = F.lit(None).cast("long")
    for i, (a, b) in enumerate(stretches):
        step = max(1, -(-(b - a) // each))
        block = F.when((end > a) & (end < b), F.lit(i * (each + 1)) + F.floor((end - a) / F.lit(step))).otherwise(block)
    found = (
        groups.select("end_bytes", block.alias("block")).where("block is not null")
        .groupBy("block").agg(F.count(F.lit(1)), F.min("end_bytes"), F.max("end_bytes"))
    )
    return [(n, a, b) for _, n, a, b in found.collect()]


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text (NULL: none) plus 8. The law is
    ``bytes``: no shard holds more than the smallest feasible capacity, and all
    rows of equal texts (NULLs among themselves) share a shard. ``slot`` counts
    the rows of a shard from 0 without gaps; rows that repeat an id get slots
    of their own. ``text_crc32`` of a NULL text is 0, as of an empty one. Where
    one group outweighs the others, trailing shards can stay empty. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    raw = F.col(text_col).cast("binary")
    rows = cut(df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("digest"),
        salt(F.col(id_col), salts).alias("salt"),
    ))
    cells = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    bucket = F.substring("digest", 1, 3)  # 4,096 buckets and the NULL texts
    by_group = cells.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("bucket", bucket)
    totals = by_group.groupBy("bucket").agg(F.sum("n").alias("bucket_n"), F.sum("bytes").alias("bucket_bytes"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the bounded bucket table
    starts = totals.select(
        "bucket",
        F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("bucket_bytes").over(before), F.lit(0)).alias("b0"),
    )
    run = Window.partitionBy("bucket").orderBy("digest")
    groups = cut(
        by_group.withColumns({"run_n": F.sum("n").over(run), "run_bytes": F.sum("bytes").over(run)})
        .join(starts, "bucket")
        .select("digest", "bytes", (F.col("n0") + F.col("run_n") - F.col("n")).alias("start_rows"),
                (F.col("b0") + F.col("run_bytes")).alias("end_bytes"))
    )
    cuts = minimax_cuts(groups, shards)
    start_bytes = F.col("end_bytes") - F.col("bytes")
    number = reduce(lambda a, b: a + b, [F.when(start_bytes >= F.lit(c), 1).otherwise(0) for c in cuts[:-1]], F.lit(0))
    placed = groups.select("digest", "start_rows", number.alias("shard"))
    # the first row of each shard; at most ``shards`` rows
    first = {s: n for s, n in placed.groupBy("shard").agg(F.min("start_rows")).collect()}
    shard_row = reduce(lambda e, s: F.when(F.col("shard") == s, F.lit(first[s])).otherwise(e), first, F.lit(0).cast("long"))
    within = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = (
        cells.withColumn("cell_rows", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(placed, "digest")
        .select("digest", "salt", "shard", (F.col("start_rows") + F.col("cell_rows") - shard_row).alias("slot0"))
    )
    order = Window.partitionBy("digest", "salt").orderBy("id")
    return rows.withColumn("rank", F.row_number().over(order)).join(cell_start, ["digest", "salt"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot0") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
