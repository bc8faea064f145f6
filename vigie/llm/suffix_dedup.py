"""Removal of repeated byte strings by sampled suffix sorting with a synchronising difference cover.

A byte goes when a string of ``WINDOW`` bytes that covers it also starts
anywhere else. The steps are those of a difference-cover suffix sort, cut off
at depth ``WINDOW``:

1. Sample: each window is represented by one position in it, chosen by content
   (``anchors``), so that two equal windows have their sample at the same
   distance. That distance is what a difference cover guarantees; this cover
   holds about 1.4 % of the positions instead of two thirds.
2. Names: a sample's name is its hashed gram; names that stand once in the
   corpus cannot belong to a repeat and are dropped.
3. Names of names: a sample's context is the stretch of all windows that it
   represents. Samples with equal (name, context) repeat as a whole.
4. Merge: what is left are windows of contexts that occur once while their
   name occurs again. They are represented by (sample, distance) and compared
   with the windows of the same name at the same distance: sorted, then
   neighbours compared byte by byte. Names with more than ``HOT`` different
   contexts have their windows dealt out one by one instead of by name; those
   are compared by two independent 64-bit hashes, not byte by byte.

Only anchors, and the few contexts of step 4, are shuffled; texts travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .ragged import prefix_hash, substring_hash, texts
from .shared import cut, numbered

WINDOW = 200
GRAM = 32
HOT = 2000
BUCKET_ROWS = 2000

# ``place`` packs (first window's start, sample's distance from it, windows - 1, 16 bits of the text's hash);
# distance and windows - 1 have eight bits each and reach window - gram
MOST_BEYOND_GRAM = 255


def packed(first, distance, more, tag: int):
    return (first << 32) | (distance << 24) | (more << 16) | tag


def sampler(window: int, gram: int):
    """mapInArrow function: (id, tag, text) to (name, context, id, place), one row per sampled position."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            ids, tags = batch.column(0), batch.column(1).to_pylist()
            found, rows = [], []
            for r in np.flatnonzero(np.diff(offsets) >= window):
                name, position, first, last, context = runs(data[offsets[r] : offsets[r + 1]], window, gram)
                found.append((name, context, packed(first, position - first, last - first, tags[r])))
                rows.append(np.full(len(name), r))
                if sum(len(x) for x in rows) > 200_000:
                    yield emit(found, rows, ids)
                    found, rows = [], []
            if rows:
                yield emit(found, rows, ids)

    def emit(found, rows, ids):
        name, context, place = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(name.view(np.int64)), pa.array(context.view(np.int64)), ids.take(pa.array(np.concatenate(rows))), pa.array(place.astype(np.int64))],
            names=["name", "context", "id", "place"])

    return sample


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places >> 32, (places >> 24) & 255, (places >> 16) & 255


def cutter(window: int):
    """mapInArrow function: (text, samples) to (bucket, name, n, id, place, bytes of the context)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(0))
            lists = batch.column(1)
            samples = lists.flatten()
            place = samples.field("place").to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            first, _, more = unpacked(place)
            begin = offsets[row] + first
            size = more + window
            ends = np.cumsum(size)
            index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - np.concatenate(([0], ends[:-1])), size)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index]))])
            yield pa.RecordBatch.from_arrays(
                [samples.field(c) for c in ("bucket", "name", "n", "id", "place")] + [raw.cast(pa.binary())], names=["bucket", "name", "n", "id", "place", "bytes"])

    return extract


def windows_of(table: pa.Table | pa.RecordBatch, window: int):
    """Every window of the contexts: (bytes, their starts, row of each window, window's number in its row, distance to the sample)."""
    data, offsets = texts(table["bytes"])
    _, distance, more = unpacked(table["place"].to_numpy())
    count = more + 1
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return data, offsets[row] + number, row, number, distance[row] - number


def window_hashes(data: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return substring_hash(prefix_hash(data), start, start + window)


def window_digests(data: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """64 bits of each window's BLAKE2b digest: evidence that ``window_hashes``, a polynomial, does not give."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a : a + window], digest_size=8).digest() for a in start.tolist()), dtype=np.int64)


def merger(window: int):
    """applyInArrow function on a bucket of whole names: the repeated windows of contexts that occur once."""

    def merge(table: pa.Table) -> pa.Table:
        data, start, row, number, distance = windows_of(table, window)
        name = table["name"].to_numpy().view(np.uint64)
        key = window_hashes(data, start, window) ^ ((name[row] + distance.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        same = np.zeros(len(again), dtype=bool)
        for a in range(0, len(again), 20_000):  # neighbours in sorted order, byte by byte
            pair = again[a : a + 20_000]
            x, y = start[order[pair]], start[order[pair + 1]]
            step = np.arange(window)
            same[a : a + 20_000] = (data[x[:, None] + step] == data[y[:, None] + step]).all(1)
        hit = np.zeros(len(start), dtype=bool)
        hit[order[again[same]]] = True
        hit[order[again[same] + 1]] = True
        return hit_runs(table, hit, row, number)

    return merge


def hit_runs(table: pa.Table, hit: np.ndarray, row: np.ndarray, number: np.ndarray) -> pa.Table:
    """One row per context that occurs once: (id, place, first and last window number of each run of hits)."""
    edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
    before = np.concatenate(([False], hit[:-1])) & ~edge
    after = np.concatenate((hit[1:], [False])) & ~np.concatenate((edge[1:], [True]))
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    runs_of: list[list[int]] = [[] for _ in range(table.num_rows)]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        runs_of[row[a]] += [int(number[a]), int(number[b])]
    once = np.flatnonzero(table["n"].to_numpy() == 1)
    return pa.table({"id": table["id"].combine_chunks().take(pa.array(once)) if isinstance(table["id"], pa.ChunkedArray) else table["id"].take(pa.array(once)),
                     "place": pa.array(table["place"].to_numpy()[once]), "hits": pa.array([runs_of[i] for i in once], pa.list_(pa.int32()))})


def window_rows_of(window: int):
    """mapInArrow function: contexts of hot names to one row per window: (name, distance, two hashes, id, place, number, n)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                data, start, row, number, distance = windows_of(part, window)
                take = lambda c: part[c].take(pa.array(row))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [take("name"), pa.array(distance), pa.array(window_hashes(data, start, window).view(np.int64)),
                     pa.array(window_digests(data, start, window)), take("id"), take("place"), pa.array(number), take("n")],
                    names=["name", "distance", "h1", "h2", "id", "place", "number", "n"])

    return explode


def remover(window: int, keep_text: bool):
    """mapInArrow function: (row, text, places, opened) to the digest columns and, on request, the remaining bytes."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            places, opened = batch.column(2), batch.column(3).to_pylist()
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]]
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                if places[r].is_valid:
                    own = places[r].values.to_numpy()
                    partly: dict[int, list[int]] = {}
                    for o in opened[r] or ():
                        partly.setdefault(o["place"], []).extend(o["hits"])
                    if partly:
                        own = own[~np.isin(own, np.fromiter(partly, dtype=np.int64))]
                    first, _, more = unpacked(own)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + more + window, -1)
                    for place, hits in partly.items():
                        for a, b in zip(hits[::2], hits[1::2], strict=True):
                            edge[(place >> 32) + a] += 1
                            edge[(place >> 32) + b + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


def opened_windows(contexts: DataFrame, hot: DataFrame, window: int, buckets: int) -> DataFrame:
    """(id, place, hits) of the contexts that occur once."""
    id_type = contexts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, place long, hits array<int>"
    usual = contexts.join(hot, "name", "left_anti") if hot is not None else contexts
    merged = usual.groupBy("bucket").applyInArrow(merger(window), schema)
    if hot is None:
        return merged
    many = contexts.join(hot, "name", "left_semi")
    rows = many.select("name", "n", "id", "place", "bytes").mapInArrow(
        window_rows_of(window), f"name long, distance long, h1 long, h2 long, id {id_type}, place long, number long, n long")
    keys = ["name", "distance", "h1", "h2"]
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    hits = (
        rows.where("n = 1").join(repeated, keys).select("id", "place", F.col("number").cast("int").alias("number"))
        .groupBy("id", "place").agg(F.collect_list("number").alias("numbers"))  # at most WINDOW numbers
        .select("id", "place", F.flatten(F.transform("numbers", lambda x: F.array(x, x))).alias("hits"))
    )
    silent = many.where("n = 1").select("id", "place", F.array().cast("array<int>").alias("hits"))
    return merged.unionAll(hits).unionAll(silent)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
                 keep_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes, on request).

    Strings are judged on the input, over all rows and within each, as UTF-8
    bytes; they never cross rows. A window may be at most 255 bytes longer than
    the gram; beyond that a ValueError is raised. NULL is the empty text; texts shorter than
    the window stay whole. Rows are told apart by their place in the table, not
    by their ids, which may repeat or be missing. Rows that repeat a text lose all that a window
    covers, as copies do. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    if window - gram > MOST_BEYOND_GRAM:
        raise ValueError(f"a window of {window} bytes needs a gram of at least {window - MOST_BEYOND_GRAM}, not {gram}")
    tag = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 16)).cast("int")
    own_type = df.schema[id_col].dataType.simpleString()
    docs = numbered(df.select(F.col(id_col).alias("own"), tag.alias("tag"), F.col(text_col).cast("binary").alias("text")), "id")
    id_type = docs.schema["id"].dataType.simpleString()
    samples = docs.select("id", "tag", "text").mapInArrow(sampler(window, gram), f"name long, context long, id {id_type}, place long")
    names = cut(samples.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    repeated = cut(samples.join(names, "name"))
    contexts = cut(repeated.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("rep")))
    open_names = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least")).where("least = 1")
    opened = cut(contexts.join(cut(open_names.select("name", "different")), "name"))
    total = opened.count()
    buckets = max(1, total // BUCKET_ROWS)
    is_hot = opened.where(F.col("different") > hot).select("name").distinct()
    hot_names = None if is_hot.isEmpty() else cut(is_hot)
    sample = F.struct(F.pmod("name", F.lit(buckets)).alias("bucket"), "name", "n", F.col("rep.id").alias("id"), F.col("rep.place").alias("place"))
    low = F.col("rep.place").bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
    per_text = opened.groupBy(F.col("rep.id").alias("id"), low.alias("tag")).agg(F.collect_list(sample).alias("samples"))  # of one text
    wanted = docs.join(per_text, docs["id"].eqNullSafe(per_text["id"]) & (docs["tag"] == per_text["tag"])).select("text", "samples")
    cuts = wanted.mapInArrow(cutter(window), f"bucket long, name long, n long, id {id_type}, place long, bytes binary")
    # One plan from here on: the texts' exchange of this join is used again by the last one.
    hits = opened_windows(cuts, hot_names, window, buckets)
    place_tag = F.col("place").bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
    places = repeated.groupBy("id", place_tag.alias("tag")).agg(F.collect_list("place").alias("places"))  # of one text
    partly = hits.groupBy("id", place_tag.alias("tag")).agg(F.collect_list(F.struct("place", "hits")).alias("opened"))
    known = places.withColumnsRenamed({"id": "pid", "tag": "ptag"}).join(
        partly.withColumnsRenamed({"id": "oid", "tag": "otag"}), F.col("pid").eqNullSafe(F.col("oid")) & (F.col("ptag") == F.col("otag")), "left")
    rows = docs.join(known, docs["id"].eqNullSafe(F.col("pid")) & (docs["tag"] == F.col("ptag")), "left").select("own", "text", "places", "opened")
    out = rows.mapInArrow(remover(window, keep_text), f"id {own_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col) if keep_text else out.drop("kept").withColumnRenamed("id", id_col)
