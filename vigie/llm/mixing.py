"""Mixing sources to target weights by subset-sum budget fitting.

Each source's documents are counted by exact length. A budget is met by taking
the same share of every length and closing the remaining words with a bounded
knapsack (dynamic programming over word sums, each length usable as often as
documents of it are left). The documents themselves are then chosen by a seeded
hash, as many of each length as the knapsack says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 20261203
KNAPSACK_WORDS = 200_000  # sums that the dynamic programme covers
CELLS = 256  # hash ranges per (source, length); a hot length is ranked range by range


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest below ``budget``.

    Takes floor(count * budget / words) of each length, then closes the rest
    with a bounded knapsack over the documents left.
    """
    words = int((lengths * counts).sum())
    if budget <= 0 or words == 0:
        return np.zeros_like(counts)
    if budget >= words:
        return counts.copy()
    take = np.array([int(c) * budget // words for c in counts], dtype=np.int64)
    rest = budget - int((take * lengths).sum())
    # Longest first while the rest is beyond the knapsack's table; the knapsack closes what remains.
    limit = max(KNAPSACK_WORDS, 2 * int(lengths.max()))
    for j in np.argsort(-lengths, kind="stable"):
        if rest <= limit:
            break
        more = min(int(counts[j] - take[j]), (rest - limit) // int(lengths[j]) + 1, rest // int(lengths[j]))
        take[j] += more
        rest -= more * int(lengths[j])
    return take + knapsack(lengths, counts - take, rest)


def knapsack(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: the reachable sum nearest below ``rest``, as counts per length.

    Sums are bits of one integer; each length enters in binary multiples. The
    first item that reaches a sum is remembered, which is enough to walk back.
    """
    took = np.zeros_like(left)
    if rest <= 0:
        return took
    mask, sums = (1 << (rest + 1)) - 1, 1
    item_of = np.full(rest + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for j in range(len(lengths)):
        n = min(int(left[j]), rest // int(lengths[j]))
        multiple = 1
        while n > 0 and not sums >> rest & 1:
            m = min(multiple, n)
            new = (sums << (m * int(lengths[j]))) & mask & ~sums
            if new:
                bits = np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), dtype=np.uint8)
                item_of[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: rest + 1])] = len(items)
                sums |= new
            items.append((j, m))
            n -= m
            multiple *= 2
    at = sums.bit_length() - 1
    while at:
        j, m = items[item_of[at]]
        took[j] += m
        at -= m * int(lengths[j])
    return took


def quotas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per source: its histogram and budget in, documents to take of each length out."""
    for batch in batches:
        for skey, budget, hist in zip(batch["skey"], batch["budget"], batch["hist"], strict=True):
            pairs = sorted((int(h["size"]), int(h["n"])) for h in hist)
            lengths = np.array([p[0] for p in pairs], dtype=np.int64)
            counts = np.array([p[1] for p in pairs], dtype=np.int64)
            yield pd.DataFrame({"skey": skey, "size": lengths, "quota": fit(lengths, counts, int(budget))})


def targets(sizes: DataFrame) -> DataFrame:
    """Each source's target from its size: (source, skey, source_size) gets weight and target.

    Weights repeat over the sources by code point, NULL last. The budget is
    shared by weight; a share above twice its source's size is cut to that and
    the excess goes to the others by weight until none is above. In order of
    size per weight the cut sources come first, so one running sum finds them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(MOST_REPEATS))
    ordered = Window.orderBy("ratio", "skey")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    leveled = (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    )
    # The first source that its share does not fill sets the level of all that follow.
    final = F.min(F.when(F.col("open"), F.struct("ratio", "skey", "level"))).over(whole)
    return leveled.withColumn("final", final["level"]).select(
        "source", "skey", "source_size", "weight",
        F.when(F.col("final").isNull() | (F.col("final") > F.col("ratio")), F.col("cap"))
        .otherwise(F.col("weight") * F.col("final")).alias("target"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
        row_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, taken, copies (and ``row``, the value of ``row_col``).

    ``size`` counts the words of the text (NULL: 0), ``copies`` says how often
    the mix takes the row (0, 1 or 2) and ``taken`` is their words. Rows
    without words are never taken twice and add none. The choice depends on the
    seed and the ids only, so reruns agree; among rows that repeat an id of the
    same source and length it does not matter which is chosen. ``row_col``
    names a column that tells rows apart; missing ids are then spread by it. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    rows = cut(df.select(
        F.col(id_col).alias("id"), row.alias("row"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), row)).otherwise(F.xxhash64(F.lit(seed), F.col(id_col))).alias("h"),
    ).withColumn("cell", F.pmod(F.col("h"), F.lit(CELLS)).cast("int")))
    cells = rows.groupBy("skey", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_source = targets(rows.groupBy("source", "skey").agg(F.sum("size").alias("source_size")))
    by_source = by_source.withColumn("base", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)).withColumn(
        "budget", F.round("target").cast("long") - F.col("base") * F.col("source_size")
    )
    hist = (
        rows.where("size > 0").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("skey").agg(F.collect_list(F.struct("size", "n")).alias("hist"))
    )
    plan = cut(by_source.join(hist, "skey", "left").select(
        "skey", "source_size", "target", "base", "budget", F.coalesce("hist", F.array().cast("array<struct<size:long,n:long>>")).alias("hist")
    ))
    quota = cut(plan.select("skey", "budget", "hist").mapInPandas(quotas, "skey string, size long, quota long"))
    earlier = Window.partitionBy("skey", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    taken_of_cell = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(quota, ["skey", "size"], "left")
        .join(plan.drop("hist", "budget"), "skey")
        .select("skey", "size", "cell", "source_size", "target", "base",
                (F.coalesce("quota", F.lit(0)) - F.col("before")).alias("open"))
    )
    rank = F.row_number().over(Window.partitionBy("skey", "size", "cell").orderBy("h", "id", "row"))
    copies = F.col("base") + F.when(F.col("rank") <= F.col("open"), 1).otherwise(0)
    return rows.withColumn("rank", rank).join(taken_of_cell, ["skey", "size", "cell"]).select(
        F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), *(["row"] if row_col else []),
    )
