"""Synchronised samples of byte strings: which position stands for a window.

For windows of ``window`` bytes, every window is assigned the position of the
smallest hashed ``gram``-byte string that lies in it (the leftmost of equals).
Equal windows, wherever they stand, get the same relative position, and the
windows assigned to one position are consecutive.
"""

from __future__ import annotations

import numpy as np

from .ragged import prefix_hash, substring_hash

LOW = np.uint64((1 << 22) - 1)  # positions within a piece
PIECE = 1 << 21  # window starts of a long text that are handled at a time


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of one text of at least ``window`` bytes: (name, position, first window start, last window start, context hash).

    The context is the bytes from the first window's start to the last one's
    end; its hash also tells where in it the position lies. A long text is
    handled in pieces, whose borders may part the windows of a position in two.
    """
    starts = range(0, len(data) - window + 1, PIECE)
    parts = [piece_runs(data[a : a + PIECE + window - 1], window, gram) for a in starts]
    if len(parts) == 1:
        return parts[0]
    shifted = [(n, p + a, f + a, z + a, c) for a, (n, p, f, z, c) in zip(starts, parts, strict=True)]
    return tuple(np.concatenate(x) for x in zip(*shifted, strict=True))


def piece_runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    prefix = prefix_hash(data)
    n = len(data) - gram + 1
    starts = np.arange(n)
    names = substring_hash(prefix, starts, starts + gram)
    keyed = (names & ~LOW) | starts.astype(np.uint64)
    at = (sliding_min(keyed, window - gram + 1) & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    position = at[first]
    context = substring_hash(prefix, first, last + window) ^ ((position - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return names[position], position, first, last, context
