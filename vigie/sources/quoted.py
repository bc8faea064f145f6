"""Delimited records whose quoted fields hold line breaks, read split by split.

A line break ends a record where the number of quotes before it is even (RFC
4180: quotes inside a quoted field are doubled). A split of a file cannot tell
on its own whether it begins inside a quoted field, so two passes are made over
the lines of the scan:

1. per split, the lines with an odd number of quotes are counted (one row per
   split comes back, as many as the driver plans splits for). Their running
   parity over a file's splits says which splits begin inside a record, and the
   last split before with such a line is where that record began;
2. every split is cut into records from its true parity on. What lies before the
   first record end of a split that begins inside a record, and what is left
   open at its end, are fragments; the fragments of a record, at most one a
   split, are joined in order. Splits without fragments shuffle nothing.

A task holds a batch of lines and the record it is in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = '"'
PIECES = "file string, owner long, seq long, first boolean, record binary"
_ARROW = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("seq", pa.int64()), ("first", pa.bool_()),
                    ("record", pa.binary())])


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # one-byte line feeds end lines; a carriage return before one is cut from the record's end
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("start"),
        meta.getField("file_block_length").alias("length"), "value")


class Splits:
    """What a scan has to know of its splits: length, and the split where the record began that they begin in (or None)."""

    def __init__(self, counted: Sequence):
        self.known: dict[tuple[str, int], tuple[int, int | None]] = {}
        self.crossing = False
        inside, owner, file = False, None, None
        for r in sorted(counted, key=lambda r: (r["file"], r["start"])):
            if r["file"] != file:
                inside, owner, file = False, None, r["file"]
            self.known[r["file"], r["start"]] = (r["length"], owner if inside else None)
            if r["odd"]:
                owner = r["start"]
            inside ^= bool(r["odd"] % 2)
            self.crossing |= inside

    @property
    def files(self) -> list[str]:
        return sorted({file for file, _ in self.known})


def count_quotes(spark: SparkSession, paths: Sequence[str]) -> Splits:
    """The first pass: JVM expressions and one partial aggregate, a row per split."""
    bare = F.replace("value", F.lit(QUOTE), F.lit(""))
    odd = ((F.octet_length("value") - F.octet_length(bare)) % 2).cast("long")
    return Splits(_lines(spark, paths).groupBy("file", "start", "length").agg(F.sum(odd).alias("odd")).collect())


def _stretches(files: pa.Array, starts: pa.Array) -> list[tuple[int, int]]:
    """Where a batch's rows are of one split: a task reads its splits one after the other."""
    name, start = files.dictionary_encode().indices.to_numpy(), starts.to_numpy()
    cuts = np.flatnonzero((name[1:] != name[:-1]) | (start[1:] != start[:-1])) + 1
    edges = [0, *cuts.tolist(), len(start)]
    return list(zip(edges, edges[1:]))


class _Out:
    def __init__(self):
        self.columns: list[list] = [[], [], [], [], []]

    def put(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self) -> list[pa.RecordBatch]:
        held, self.columns = self.columns, [[], [], [], [], []]
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, _ARROW.types)], schema=_ARROW)] if held[0] else []


def _cut(batches: Iterator[pa.RecordBatch], known: dict, whole: bool) -> Iterator[pa.RecordBatch]:
    """Records of the splits that come past: those within a split, or else the fragments."""
    split, inside, owner, first, pending, out = None, False, None, False, [], _Out()

    def end_of_split() -> None:
        if pending and not whole:
            out.put(split[0], owner, split[1], first, b"\n".join(pending))
        pending.clear()

    for batch in batches:
        files, starts, lengths, values = batch.columns
        for a, b in _stretches(files, starts):
            if (here := (files[a].as_py(), starts[a].as_py())) != split:
                end_of_split()
                split = here
                if known.get(split, (None,))[0] != lengths[a].as_py():
                    raise RuntimeError(f"{split[0]}: the scan's splits are not those that were counted; were its files or the session's split size changed?")
                before = known[split][1]
                inside = before is not None
                owner, first = (before, False) if inside else (split[1], split[1] == 0)
            lines = values.slice(a, b - a)
            odd = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False) % 2
            after = (np.cumsum(odd) + inside) % 2
            texts, begin = lines.to_pylist(), 0
            for stop in (np.flatnonzero(after == 0) + 1).tolist():
                if whole == (owner == split[1]):
                    out.put(split[0], owner, split[1], first,
                            b"\n".join([*pending, *texts[begin:stop]]) if pending or stop - begin > 1 else texts[begin])
                pending.clear()
                owner, first, begin = split[1], False, stop
            pending.extend(texts[begin:])
            inside = bool(after[-1])
        yield from out.batch()
    end_of_split()
    yield from out.batch()


def quoted_records(spark: SparkSession, paths: Sequence[str], splits: Splits | None = None) -> DataFrame:
    """One row per record: ``file``, ``first`` (it is its file's first) and ``record``, its undecoded bytes without the line end."""
    splits = splits or count_quotes(spark, paths)
    # a few dozen bytes per split travel to the tasks, as many as Spark's own list of splits
    known = splits.known
    lines = _lines(spark, paths).withColumn("value", F.col("value").cast("binary"))
    records = lines.mapInArrow(lambda batches: _cut(batches, known, True), PIECES).select("file", "first", "record")
    if splits.crossing:
        fragments = lines.mapInArrow(lambda batches: _cut(batches, known, False), PIECES)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "record"))), lambda p: p.getField("record"))
        # a record's fragments: as many as the splits that it spans
        joined = fragments.groupBy("file", "owner").agg(F.max("first").alias("first"), parts.alias("parts"))
        glued = F.aggregate("parts", F.lit(None).cast("binary"),
                            lambda acc, p: F.when(acc.isNull(), p).otherwise(F.concat(acc, F.lit(b"\n"), p)))
        records = records.unionByName(joined.select("file", "first", glued.alias("record")))
    bare = F.when(F.substring("record", -1, 1) == F.lit(b"\r"), F.expr("substring(record, 1, octet_length(record) - 1)")).otherwise(F.col("record"))
    return records.withColumn("record", bare).where(F.octet_length("record") > 0)
