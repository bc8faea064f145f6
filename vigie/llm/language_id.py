"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the
counts of the bytes seen after them. A byte's code length under a language
starts at the longest context: a byte seen there costs -log2 c/(n+d), another
one costs the escape -log2 d/(n+d) and is coded in the next shorter context
(n bytes and d different ones seen after the context), down to the uniform
256-letter alphabet. Statistics are frozen: scoring never updates them. The
language with the shortest code of the whole text is predicted.

Escapes, contexts and code lengths are resolved in advance into one table per
order: (context, byte) -> code length of every language. Scoring looks the
bytes of a batch up in the longest order and takes only what is not found
there down to shorter ones, with the escapes on the way.

The trees are learned from at most ``TRAIN_ROWS`` texts per language, chosen
by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import slices, texts

ORDER = 4
TRAIN_ROWS = 300
FOLD, HELD_OUT = 4, 2
SEED = 20261203
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bytes in each code): every byte with up to ``order`` bytes before it in its row."""
    codes = data.astype(np.uint64)
    room = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))  # bytes before, in the row
    for k in range(1, order + 1):
        before = np.zeros(len(data), dtype=np.uint64)
        before[k:] = data[:-k] if k < len(data) else []
        before[room < k] = 0
        codes |= before << np.uint64(8 * k)
    return codes, np.minimum(room, order) + 1


def counter(order: int):
    """mapInArrow function: (lang, text) to counts of (lang, bytes in the gram, gram) per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            parts = []
            for lang in sorted(set(langs)):
                for k in range(order + 1):
                    own = []
                    for r in (r for r, x in enumerate(langs) if x == lang):
                        codes, room = grams(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), k)
                        own.append(codes[room == k + 1])
                    codes, n = np.unique(np.concatenate(own), return_counts=True)
                    parts.append(pd.DataFrame({"lang": lang, "length": k + 1, "gram": codes.view(np.int64), "n": n}))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts), preserve_index=False)

    return count


def hash_table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open-addressed table of codes: (codes by slot, their index or -1 by slot, shift)."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
    shift = 64 - bits
    size = 1 << bits
    slots, index = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
    todo = np.arange(len(codes))
    at = (codes * FACTOR) >> np.uint64(shift)
    while len(todo):
        free = index[at[todo]] < 0
        _, first = np.unique(at[todo[free]], return_index=True)
        put = todo[free][first]
        slots[at[put]], index[at[put]] = codes[put], put
        rest = np.ones(len(todo), dtype=bool)
        rest[np.flatnonzero(free)[first]] = False
        todo = todo[rest]
        at[todo] = (at[todo] + np.uint64(1)) & np.uint64(size - 1)
    return slots, index, shift


def lookup(table: tuple[np.ndarray, np.ndarray, int], codes: np.ndarray) -> np.ndarray:
    """Index of each code in the table, -1 where it is not in it."""
    slots, index, shift = table
    at = ((codes * FACTOR) >> np.uint64(shift)).astype(np.int64)
    found = index[at]
    wrong = np.flatnonzero((found >= 0) & (slots[at] != codes))
    while len(wrong):
        at[wrong] = (at[wrong] + 1) & (len(slots) - 1)
        found[wrong] = index[at[wrong]]
        wrong = wrong[(found[wrong] >= 0) & (slots[at[wrong]] != codes[wrong])]
    return found


def build(counts: pd.DataFrame, order: int) -> dict:
    """The frozen model from (lang, length, gram, n): per order the known grams' and contexts' tables. Plain arrays."""
    langs = sorted(counts["lang"].unique())
    number = {x: i for i, x in enumerate(langs)}
    model = {"langs": langs, "orders": []}
    for k in range(order + 1):
        own = counts[counts["length"] == k + 1]
        lang = own["lang"].map(number).to_numpy(dtype=np.int64)
        gram, n = own["gram"].to_numpy(dtype=np.int64).view(np.uint64), own["n"].to_numpy(dtype=np.float64)
        context = gram >> np.uint64(8)
        contexts, which = np.unique(context, return_inverse=True)
        total, different = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, (which, lang), n)
        np.add.at(different, (which, lang), 1.0)
        # escape costs; an unseen context costs nothing, it is not coded in
        share = np.divide(different, total + different, out=np.ones_like(total), where=total > 0)
        escape = -np.log2(share)
        codes, place = np.unique(gram, return_inverse=True)
        count = np.zeros((len(codes), len(langs)))
        np.add.at(count, (place, lang), n)
        home = np.searchsorted(contexts, codes >> np.uint64(8))
        shorter = code_lengths(model, codes & np.uint64((1 << (8 * k)) - 1), np.full(len(codes), k)) if k else np.full((len(codes), len(langs)), 8.0)
        all_seen = total[home] + different[home]
        bits = np.where(count > 0, -np.log2(np.where(count > 0, count / np.where(all_seen > 0, all_seen, 1), 1)), escape[home] + shorter)
        model["orders"].append((hash_table(codes), bits.astype(np.float32), hash_table(contexts), escape.astype(np.float32)))
    return model


def code_lengths(model: dict, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte under every language; ``room`` says how many bytes the gram has."""
    out = np.zeros((len(codes), len(model["langs"])), dtype=np.float32)
    todo = np.arange(len(codes))
    for k in range(len(model["orders"]) - 1, -1, -1):
        table, bits, contexts, escape = model["orders"][k]
        fit = room[todo] >= k + 1
        here = todo[fit]
        if not len(here):
            continue
        own = codes[here] & np.uint64((1 << (8 * (k + 1))) - 1) if k < 7 else codes[here]
        found = lookup(table, own)
        known = found >= 0
        out[here[known]] += bits[found[known]]
        lost = here[~known]
        seen = lookup(contexts, own[~known] >> np.uint64(8))
        out[lost[seen >= 0]] += escape[seen[seen >= 0]]
        todo = np.concatenate((todo[~fit], lost)) if not fit.all() else lost
        if not len(todo):
            return out
    out[todo] += 8.0
    return out


def predictor(model):
    """mapInArrow function: (id, text) to (id, code length of every language in bits)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        order, langs = len(own["orders"]) - 1, len(own["langs"])
        for batch in batches:
            data, offsets = texts(batch.column(1))
            sums = np.zeros((batch.num_rows, langs))
            for r0, r1 in slices(offsets, 1 << 18):
                at = offsets[r0 : r1 + 1] - offsets[r0]
                bits = code_lengths(own, *grams(data[offsets[r0] : offsets[r1]], at, order))
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    sums[r0 + full] = np.add.reduceat(bits, at[full], axis=0, dtype=np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * langs), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["row", "bits"])

    return predict


def held_out(id_col: str, fold: int = FOLD, remainder: int = HELD_OUT):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == remainder


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          train_rows: int = TRAIN_ROWS) -> dict:
    """Learn each language's context tree from at most ``train_rows`` of its texts outside the held-out fold.

    Texts are drawn by a hash of id and text, so that ids that repeat neither
    fill the sample nor empty it; rows that repeat both count once.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    # A sample of the ids by hash, about four times as many as needed, then the first ones of each language.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, (4 * train_rows + 100) / n))).otherwise(part)
    h = F.xxhash64(F.lit(SEED), "id", "text")
    drawn = known.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < part)
    order_in = Window.partitionBy("lang").orderBy("h")  # some four times the sample
    chosen = drawn.select("lang", "h").distinct().withColumn("place", F.row_number().over(order_in)).where(F.col("place") <= train_rows).drop("place")
    sample = drawn.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    counts = (
        sample.select("lang", "text").mapInArrow(counter(order), "lang string, length long, gram long, n long")
        .groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    )
    return build(counts, order)


def identify(df: DataFrame, model: dict, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry``, lang_pred, score and bits (code length per language of the model), one row per input row.

    The shortest code wins, the first language by code point on a tie. The
    score is the share of the winner when every language weighs 2**-bits.
    A NULL text, or one without a letter, is ``und`` with score 0, as is every
    text of a model without languages.
    """
    letters = F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False))
    rows = df.select(F.struct(F.struct(*carry).alias("own"), letters.alias("letters")).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("bits", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(predictor(df.sparkSession.sparkContext.broadcast(model)), schema)
    least = F.array_min("bits")
    best = F.element_at(F.array(*[F.lit(x) for x in model["langs"]]), F.array_position("bits", least).cast("int")) if model["langs"] else F.lit(None)
    weight = F.aggregate(F.transform("bits", lambda b: F.pow(F.lit(2.0), least - b)), F.lit(0.0), lambda a, b: a + b)
    known = F.col("row.letters") & F.lit(bool(model["langs"]))
    return found.select(
        *[F.col("row.own")[c].alias(c) for c in carry],
        F.when(known, best).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(known, 1.0 / weight).otherwise(F.lit(0.0)).alias("score"),
        "bits",
    )


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score.

    Learns from this table's own labelled rows outside the held-out fold and
    predicts every row from its text alone. Repeated rows are predicted each;
    a NULL id is not held out (NULL) and never learned from. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    found = identify(df, train(df, id_col, text_col, lang_col), [id_col], text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
