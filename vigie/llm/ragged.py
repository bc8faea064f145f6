"""Vectorised work on batches of texts: one byte array and the offsets of its rows.

Texts come from Spark as Arrow batches; Arrow already keeps a string column as
one UTF-8 buffer with offsets, so words, word hashes and window hashes are
array expressions over that buffer. Rows are handled in slices of about
``SLICE`` bytes (a longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Word bytes: all but ASCII white space; or ASCII letters and digits and all non-ASCII bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.ones(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False
ALNUM[65:91] = True  # they become letters when lower-cased


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n-1 and their inverses, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(n - 1, 4095).bit_length()
        for name, base in (("_powers", int(BASE)), ("_inverse", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverse[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte * BASE**position, with a leading 0; differences give substring hashes."""
    power, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the same bytes stand."""
    _, inverse = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a slice of rows: byte ranges, hashes, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data = LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = is_word[data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]  # a word ends where its row does
        edges = edges[(edges > 0) & (edges < len(data))]
        cut = edges[inside[edges] & inside[edges + 1]]
        starts[cut] = True
        ends[cut - 1] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.hash = substring_hash(prefix_hash(self.data), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)  # of each row, and of the end
        self.count = np.diff(self.first)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1 with one space between."""
        raw = self.data.data
        return b" ".join(bytes(raw[s:e]) for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (of any rows)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= BASE
        out += words[j : len(words) - n + 1 + j]
    return mix64(out + np.uint64(n))


def window_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every n-word window that lies in one row, and the number of windows per row."""
    per_row = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(per_row)[:-1])), per_row)
    return begin + np.arange(per_row.sum()), per_row
