"""Features of GeoJSON collections, one document read by many tasks.

A feature is an object that opens within two brackets, the collection's and
its list's. JSON text holds no line break inside a string, so every line starts
outside of one and the depth at a split's start is the sum of the brackets
before it. As for quoted records two passes are made over the lines: the first
sums each split's brackets and notes how deep it starts and dips (one row per
split comes back), the second cuts the features out, and those that cross a
border are joined from their fragments, one a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quoted import _lines, _stretches

TEXT = re.compile(rb'"(?:[^"\\]|\\.)*"')
DEPTH = np.zeros(256, dtype=np.int8)
DEPTH[[ord("{"), ord("[")]] = 1
DEPTH[[ord("}"), ord("]")]] = -1
INSIDE = 3  # depth from a feature's bracket on
COUNTS = "file string, start long, length long, brackets long, low long"
PIECES = "file string, owner long, seq long, feature string"
_COUNTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("brackets", pa.int64()), ("low", pa.int64())])
_PIECES = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("seq", pa.int64()), ("feature", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, start, length, lines) of the splits that come past, a split's lines in one or several pieces."""
    for batch in batches:
        files, starts, lengths, values = batch.columns
        for a, b in _stretches(files, starts):
            yield files[a].as_py(), starts[a].as_py(), lengths[a].as_py(), b"".join(v + b"\n" for v in values.slice(a, b - a).to_pylist())


def _depths(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without what stands in strings, and the depth behind each of them."""
    bare = np.frombuffer(TEXT.sub(lambda m: b" " * len(m[0]), text), dtype=np.uint8)
    return bare, np.cumsum(DEPTH[bare], dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass: per piece of a split, its brackets and its least depth, from its own start."""
    rows = []
    for file, start, length, text in _runs(batches):
        _, depth = _depths(text)
        if rows and rows[-1]["file"] == file and rows[-1]["start"] == start:
            rows[-1]["low"] = min(rows[-1]["low"], rows[-1]["brackets"] + int(depth.min()))
            rows[-1]["brackets"] += int(depth[-1])
        else:
            rows.append({"file": file, "start": start, "length": length, "brackets": int(depth[-1]), "low": min(0, int(depth.min()))})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_COUNTS)


class Depths:
    """Per split: length, depth at its start, and the split where the feature began that it starts in (or None)."""

    def __init__(self, counted: Sequence):
        self.known: dict[tuple[str, int], tuple[int, int, int | None]] = {}
        self.crossing = False
        depth, owner, file = 0, None, None
        for r in sorted(counted, key=lambda r: (r["file"], r["start"])):
            if r["file"] != file:
                depth, owner, file = 0, r["start"], r["file"]
            inside = depth >= INSIDE
            self.crossing |= inside
            self.known[r["file"], r["start"]] = (r["length"], depth, owner if inside else None)
            if depth + r["low"] < INSIDE:  # the feature that is open at its end, if any, began here
                owner = r["start"]
            depth += r["brackets"]


def _cut(batches: Iterator[pa.RecordBatch], known: dict, whole: bool) -> Iterator[pa.RecordBatch]:
    """The second pass: features within a split, or else the fragments of those that cross borders."""
    split, depth, owner, pending, out = None, 0, None, [], []

    def put(feature: bytes) -> None:
        if whole == (owner == split[1] and not crossing_out):
            out.append({"file": split[0], "owner": owner, "seq": split[1], "feature": feature.decode("utf-8", "replace")})

    def end_of_split() -> None:
        nonlocal crossing_out
        if pending:
            crossing_out = True
            put(b"".join(pending))
            crossing_out = False
        pending.clear()

    crossing_out = False
    for file, start, length, text in _runs(batches):
        if (file, start) != split:
            if split is not None:
                end_of_split()
            split = (file, start)
            if known.get(split, (None,))[0] != length:
                raise RuntimeError(f"{file}: the scan's splits are not those that were counted; were its files or the session's split size changed?")
            _, depth, before = known[split]
            owner = start if before is None else before
        bare, local = _depths(text)
        at = local + depth
        opens = np.flatnonzero((bare == ord("{")) & (at == INSIDE)).tolist()
        closes = np.flatnonzero((bare == ord("}")) & (at == INSIDE - 1)).tolist()
        begin = 0 if depth >= INSIDE else None
        opens.reverse()
        for stop in closes:
            if begin is None:
                while opens and opens[-1] < stop:
                    begin = opens.pop()
            if begin is None:
                continue
            pending.append(text[begin:stop + 1])
            put(b"".join(pending))
            pending.clear()
            owner, begin = start, None
        rest = [o for o in opens if not closes or o > closes[-1]]
        if begin is not None:  # still in the feature that it started in
            pending.append(text)
        elif rest:
            owner = start
            pending.append(text[min(rest):])
        depth += int(local[-1])
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
            out = []
    if split is not None:
        end_of_split()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)


def feature_texts(spark: SparkSession, paths: Sequence[str], depths: Depths | None = None) -> DataFrame:
    """One row per object within the brackets of a feature, as JSON text in ``feature``."""
    lines = _lines(spark, paths).withColumn("value", F.col("value").cast("binary"))
    depths = depths or Depths(lines.mapInArrow(_count, COUNTS).groupBy("file", "start", "length").agg(
        F.sum("brackets").alias("brackets"), F.min("low").alias("low")).collect())  # a row per split; a task holds a split's pieces
    known = depths.known
    features = lines.mapInArrow(lambda batches: _cut(batches, known, True), PIECES).select("feature")
    if depths.crossing:
        fragments = lines.mapInArrow(lambda batches: _cut(batches, known, False), PIECES)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "feature"))), lambda p: p.getField("feature"))
        joined = fragments.groupBy("file", "owner").agg(F.array_join(parts, "").alias("feature"))  # a feature's fragments
        features = features.unionByName(joined.select("feature"))
    return features
