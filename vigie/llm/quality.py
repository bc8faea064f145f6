"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the whole text are put into bins by quantile. Boosting
goes round the features in a cycle and fits, each time, one shallow tree on one
feature to the current log-loss gradient; the trees of a feature add up to one
lookup table over its bins. The pairs of features with the largest remaining
gain are then boosted in the same way with four-leaf trees on two features. A
score is a sum of table entries, so scoring a batch is one vectorised addition
per feature and pair.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash
of the id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import NOT_SPACE, Words, slices, texts, window_hash, window_rows

TRAIN_ROWS = 20_000
FOLD, HELD_OUT = 5, 0
CUTOFF = 0.3
SEED = 20261203
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 8, 0.1
LEAST_LEAF = 5.0  # hessian of a leaf

FEATURES = (
    "bytes", "words", "word_length", "lines", "line_length", "upper", "lower", "digits", "spaces", "stops", "symbols", "bars",
    "non_ascii", "distinct_words", "distinct_shingles", "same_word", "same_line", "symbol_ends", "long_words", "capital_starts",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint64)
    out[list(chars)] = 1
    return out


UPPER, LOWER, DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
SPACE, STOP, BAR = _class(b" \t\n\r\x0b\x0c"), _class(b".,;:?'\"()-"), _class(b"|")
HIGH = _class(bytes(range(128, 256)))
SYMBOL = np.uint64(1) - (UPPER + LOWER + DIGIT + SPACE + STOP + BAR + HIGH)
# two counts in each 64-bit sum
PACKS = [a + (b << np.uint64(32)) for a, b in ((UPPER, LOWER), (DIGIT, SPACE), (STOP, SYMBOL), (BAR, HIGH))]
LINE = np.ones(256, dtype=bool)
LINE[10] = False


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``at``."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[at[1:]] - total[at[:-1]]


def distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values of each row, from one sort of row number and hash."""
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort((rows << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(counts))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a slice; a text without words has zeros."""
    size = np.diff(offsets).astype(float)
    counts = []
    for pack in PACKS:
        both = per_row(pack[data], offsets)
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    upper, lower, digit, space, stop, symbol, bar, high = counts
    words = Words(data, offsets, NOT_SPACE)
    n = words.count.astype(float)
    length = (words.end - words.start).astype(np.int64)
    starts, windows = window_rows(words.first, 4)
    shingles = window_hash(words.hash, 4)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    same = np.zeros(len(words.hash), dtype=np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.first[:-1][words.count > 0]] = 0
    last, first = data[words.end - 1], data[words.start]
    lines = Words(data, offsets, LINE)
    some = lambda x, y: np.divide(x, y, out=np.zeros(len(size)), where=y > 0)
    return np.stack([
        np.log1p(size), np.log1p(n), some(per_row(length, words.first).astype(float), n), np.log1p(lines.count), some(n, lines.count.astype(float)),
        some(upper, upper + lower), some(lower, size), some(digit, size), some(space, size), some(stop, n), some(symbol, n), some(bar, n),
        some(high, size), some(distinct(words.hash, words.count).astype(float), n), some(distinct(shingles, windows).astype(float), windows.astype(float)),
        some(per_row(same, words.first).astype(float), n), 1 - some(distinct(lines.hash, lines.count).astype(float), lines.count.astype(float)),
        some(per_row(SYMBOL[last].astype(np.int64), words.first).astype(float), n), some(per_row((length > 20).astype(np.int64), words.first).astype(float), n),
        some(per_row(UPPER[first].astype(np.int64), words.first).astype(float), n),
    ], axis=1)


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature: the best cut, then the best cut of one side."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
            gain = np.where((lh >= LEAST_LEAF) & (rh >= LEAST_LEAF), lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the best four-leaf cut of a two-way histogram."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda c: np.stack([c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]])
    qg, qh = quarter(cg), quarter(ch)
    gain = np.where(qh.min(0) >= LEAST_LEAF, (qg**2 / (qh + 1)).sum(0), 0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    if gain[i, j] > 0:
        leaf = -qg[:, i, j] / (qh[:, i, j] + 1)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: intercept, bin edges and one table per feature and chosen pair. Plain arrays, ready to broadcast."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = {"base": float(np.log(rate / (1 - rate))), "edges": edges, "coarse": coarse, "tables": [np.zeros(len(e) + 1) for e in edges], "pairs": {}}
    if not 0 < y.sum() < len(y):
        return model
    total = np.full(len(y), model["base"])
    bins, pair_bins = bins_of(x, edges), bins_of(x, coarse)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, tab in enumerate(model["tables"]):
            g, h = slope()
            step = RATE * line_tree(np.bincount(bins[:, j], g, len(tab)), np.bincount(bins[:, j], h, len(tab)))
            tab += step
            total += step[bins[:, j]]

    def grid(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return pair_bins[:, a] * shape[1] + pair_bins[:, b], shape

    def tree(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        at, shape = grid(a, b)
        g, h = slope()
        fold = lambda v: np.bincount(at, v, shape[0] * shape[1]).reshape(shape)
        return *(cross_tree(fold(g), fold(h)) if min(shape) > 1 else (0.0, np.zeros(shape))), at

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -tree(*p)[0])[:PAIRS]
    model["pairs"] = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for (a, b), tab in model["pairs"].items():
            _, step, at = tree(a, b)
            tab += RATE * step
            total += RATE * step.reshape(-1)[at]
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: additions of table entries."""
    bins, pair_bins = bins_of(x, model["edges"]), bins_of(x, model["coarse"])
    total = np.full(len(x), model["base"])
    for j, tab in enumerate(model["tables"]):
        total += tab[bins[:, j]]
    for (a, b), tab in model["pairs"].items():
        total += tab[pair_bins[:, a], pair_bins[:, b]]
    return 1 / (1 + np.exp(-total))


def batch_features(column: pa.Array) -> np.ndarray:
    data, offsets = texts(column)
    parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch_features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["label", "x"])


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(own, batch_features(batch.column(1))))], names=["row", "score"])

    return run


def held_out(id_col: str, fold: int = FOLD, remainder: int = HELD_OUT):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == remainder


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold, one of each id.

    Rows without an id or label are not learned from; of rows that repeat an
    id, the text with the smallest hash is. Without rows of both
    labels the model is the smoothed share of label 1.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    )
    # a bound on the hash leaves a few more than needed, so that tasks send no more than these to be ordered
    h = F.xxhash64(F.lit(SEED), "id")
    share = min(1.0, (1.2 * train_rows + 1000) / max(1, known.count()))
    few = known if share == 1.0 else known.where(h < F.lit(int(share * 2**64) - 2**63))
    chosen = few.orderBy(h, "id").limit(train_rows)
    # at most ``train_rows`` (id, label) pairs are broadcast
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("one")).select("one.*")
    got = rows.mapInArrow(feature_rows, "label double, x array<double>").toArrow()
    y = got["label"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order the rows came in
    return fit(x[order], y[order])


def scored(df: DataFrame, model: dict, carry: list[str], text_col: str = "text") -> DataFrame:
    """(row: struct of ``carry``, score), one row per input row; NULL is scored as the empty text."""
    rows = df.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(scorer(df.sparkSession.sparkContext.broadcast(model)), schema)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted (1 from ``cutoff`` on).

    Scores depend on the text alone. Repeated rows are scored each; a NULL id
    is not held out (NULL) and never learned from. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    found = scored(df, train(df, labels, id_col, text_col), [id_col], text_col).select(F.col("row")[id_col].alias(id_col), "score")
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, all columns unchanged."""
    model = train(df, labels, id_col, text_col)
    return scored(df, model, df.columns, text_col).where(F.col("score") >= cutoff).select("row.*")
