"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows.

Every window of ``WINDOW`` consecutive words of a benchmark item goes into a
hash set; an item of fewer words is one window of its own length. Each text is
scanned window by window against the set, and a hit counts only after its words
have been compared. Hit words, spans and items come out per document.

The set is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words (a
larger single item is a block of its own). One block serves any usual
benchmark; beyond it the documents are scanned once per block and the blocks'
spans are merged per document, and cut from the texts last.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import ALNUM, Words, slices, texts, window_hash, window_rows

WINDOW = 10
BLOCK_WORDS = 2_000_000
FOUND = "n_words long, spans array<struct<first:int,last:int>>, items array<string>, kept_text string"


def window_set(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The windows of a block of items, per length: hashes, a bit filter over them, and their words with item ids."""
    by_length: dict[int, dict[bytes, set[str | None]]] = {}
    hashes: dict[int, set[int]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words = Words(raw, np.array([0, len(raw)]), ALNUM)
        n = min(window, len(words.hash))
        if not n:
            continue
        hashes.setdefault(n, set()).update(window_hash(words.hash, n).tolist())
        for i in range(len(words.hash) - n + 1):
            by_length.setdefault(n, {}).setdefault(words.text(i, i + n), set()).add(item)
    out = []
    for n, found in by_length.items():
        known = np.array(sorted(hashes[n]), dtype=np.uint64)
        bits = np.zeros(1 << 20, dtype=bool)
        bits[known >> np.uint64(44)] = True
        out.append((n, known, bits, {k: ordered(v) for k, v in found.items()}))
    return out


def ordered(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def hits(index: list[tuple], words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first word, window length, items) of every verified occurrence."""
    for n, known, bits, found in index:
        starts, _ = window_rows(words.first, n)
        hashes = window_hash(words.hash, n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
        near = np.flatnonzero(bits[hashes >> np.uint64(44)])
        near = near[np.isin(hashes[near], known)]
        for i in starts[near].tolist():
            items = found.get(words.text(i, i + n))
            if items:
                yield i, n, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanner(block, keep_text: bool):
    """mapInArrow function: rows of (row, text) get FOUND's columns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in batches:
            data, offsets = texts(batch.column(1))
            rows = len(offsets) - 1
            counts = np.zeros(rows, dtype=np.int64)
            spans: list[list] = [[]] * rows
            items: list[list] = [[]] * rows
            kept: list = [None] * rows
            for r0, r1 in slices(offsets):
                base = offsets[r0]
                words = Words(data[base : offsets[r1]], offsets[r0 : r1 + 1] - base, ALNUM)
                counts[r0:r1] = words.count
                by_row: dict[int, list] = defaultdict(list)
                for i, n, hit in hits(index, words):
                    by_row[int(np.searchsorted(words.first, i, side="right")) - 1].append((i, n, hit))
                for r, own_hits in by_row.items():
                    first = int(words.first[r])
                    own = merged([(i - first, i - first + n) for i, n, _ in own_hits])
                    spans[r0 + r] = [{"first": a, "last": b - 1} for a, b in own]
                    items[r0 + r] = ordered({x for _, _, hit in own_hits for x in hit})
                    if keep_text:
                        kept[r0 + r] = without(data[offsets[r0 + r] : offsets[r0 + r + 1]], words, first, own, int(offsets[r0 + r] - base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                 pa.array(items, pa.list_(pa.string())), pa.array(kept, pa.string())],
                names=["row", "n_words", "spans", "items", "kept_text"],
            )

    return scan


def without(raw: np.ndarray, words: Words, first: int, spans: list[tuple[int, int]], shift: int) -> str:
    """The text without the words of the spans and what stands between them."""
    keep = np.ones(len(raw), dtype=bool)
    for a, b in spans:
        keep[words.start[first + a] - shift : words.end[first + b - 1] - shift] = False
    return raw[keep].tobytes().decode()


def span_cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (row, n_words, spans, items, text) with the text, where it has spans, cut to ``kept_text``."""
    for batch in batches:
        data, offsets = texts(batch.column(4))
        kept: list = [None] * batch.num_rows
        for r, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                raw = data[offsets[r] : offsets[r + 1]]
                words = Words(raw, np.array([0, len(raw)]), ALNUM)
                kept[r] = without(raw, words, 0, [(s["first"], s["last"] + 1) for s in spans], 0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, pa.string())], names=["row", "n_words", "spans", "items", "kept_text"])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int, null_items: bool) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, read one block at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    if not null_items:
        items = items.where("item is not null")
    # at most one window, of WINDOW words, per character
    size = F.coalesce(F.length("text"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // (2 * block_words)) or 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(n)) == b) if n > 1 else items
        yield window_set([(r["item"], r["text"]) for r in part.toLocalIterator()], window)


def contamination(df: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False,
                  null_items: bool = False) -> DataFrame:
    """(row: struct of ``carry``, n_words, spans, items, kept_text), one row per input row.

    ``spans`` are the maximal runs of hit words (numbers from 0, both ends
    included), ``items`` the item ids (as strings) with an occurring window,
    and ``kept_text`` the text without its spans, where it has any and
    ``keep_text`` is set. NULL and empty texts have no words; items without
    words have no window, items of the same id share one. Items without an id
    are left out unless ``null_items`` is set: then their windows count like any
    other, and together they are one item, NULL, which stands last. Repeated
    rows are each reported. An empty benchmark hits nothing, an empty table gives no
    rows.
    """
    spark = df.sparkSession
    sets = [spark.sparkContext.broadcast(block) for block in blocks(benchmark, item_col, item_text_col, window, block_words, null_items)]
    # the text's hash keeps repeated ids of different texts apart when blocks are merged; spans are cut from the text itself
    body = [F.col(text_col).alias("body")] if keep_text and len(sets) > 1 else []
    rows = df.select(F.struct(F.struct(*carry).alias("own"), F.xxhash64(text_col).alias("hash"), *body).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(FOUND).fields])
    scans = [rows.mapInArrow(scanner(block, keep_text and not body), schema) for block in sets]
    if len(scans) == 1:
        return scans[0].withColumn("row", F.col("row.own"))
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionAll(scan)
    together = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / len(scans)).cast("int").alias("copies"),
    )
    kept_text = F.col("row.body") if body else F.lit(None).cast("string")
    out = together.select(F.col("row.own").alias("row"), "n_words", merge_spans(F.col("spans")).alias("spans"), "items",
                          kept_text.alias("kept_text"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return out.mapInArrow(span_cutter, out.schema) if body else out


def merge_spans(spans):
    """Overlapping spans of several blocks as maximal ones."""
    return F.aggregate(
        F.array_sort(spans), F.filter(spans, lambda x: F.lit(False)),
        lambda s, x: F.when((F.size(s) > 0) & (x["first"] <= F.try_element_at(s, F.lit(-1))["last"] + 1), F.concat(
            F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(s, F.lit(-1))["first"].alias("first"),
                             F.greatest(F.try_element_at(s, F.lit(-1))["last"], x["last"]).alias("last"))).cast("array<struct<first:int,last:int>>"),
        )).otherwise(F.concat(s, F.array(x))),
    )


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``contamination`` (which carried ``id_col``); a NULL item counts, but adds no id to the digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        F.col("row")[id_col].alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def remove_documents(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that hold no benchmark window, all columns unchanged."""
    return contamination(df, benchmark, df.columns, **options).where(F.size("spans") == 0).select("row.*")


def remove_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of ``df``, their texts without the benchmark's spans."""
    found = contamination(df, benchmark, df.columns, text_col=text_col, keep_text=True, **options)
    return found.select(*[F.coalesce("kept_text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
