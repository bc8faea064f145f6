"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Every text gets its set of word shingles (64-bit hashes) and a MinHash
   signature of ``COORDINATES`` values. Texts with the same word sequence are
   one class; only its representative (smallest id) goes on.
2. Each representative is posted under its coordinate-value pairs. A pair of
   texts is a candidate when it collides in at least ``MATCHES`` coordinates.
   Then it also collides in one of the ``COORDINATES - MATCHES + 1`` pairs that
   are rarest in the corpus (prefix filter), so only these postings are kept.
   A text whose prefix holds only pairs of its own is skipped altogether.
3. Posting lists are merged without writing out all pairs of a list: in each of
   ``ROUNDS`` rounds every member of a list meets one pivot; the collisions of
   that pair are counted over the whole signatures, and pairs with enough are
   confirmed on the full shingle sets. In the first round the pivot is the most
   central member, whose coordinate values are the most common ones: in a group
   of near copies that is a text with few changes of its own, which most others
   are linked to directly. Texts already in one component need not
   meet, so lists within one component are skipped. The lists that still hold
   several components then have all their possible links across components found
   by an exact prefix join on the full sets (``across``), so that none is lost.
   Its pairs pass a bitmap filter within the join: the parities of a set's
   hashes in ``BITS`` cells differ between two sets in no more cells than the
   sets differ in elements, so a pair that differs in too many cells is no link.
4. Components are found on the confirmed links.

With 64 coordinates and at least 38 matches, a pair of similarity 0.8 or more
is missed as a candidate with probability below 0.0001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .ragged import NOT_SPACE, Words, mix64, slices, texts, window_hash, window_rows
from .shared import cut

SHINGLE = 4
THRESHOLD = 80  # per cent
COORDINATES = 64
MATCHES = 38
ROUNDS = 2
MEETINGS = 8
BITS = 1024
SEED = 20261203


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each row and the end): n-word shingles; a row of fewer words has one, an empty row none."""
    starts, per_row = window_rows(words.first, n)
    rows = np.repeat(np.arange(len(per_row)), per_row)
    hashes = window_hash(words.hash, n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        extra = [window_hash(words.hash[words.first[r] : words.first[r + 1]], int(words.count[r]))[0] for r in short]
        rows = np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], np.concatenate((hashes, np.array(extra, dtype=np.uint64)))[order]
    return hashes, np.searchsorted(rows, np.arange(len(per_row) + 1))


def slices_of(batch: pa.RecordBatch, n: int):
    """(first row, Words, shingle hashes, offsets into them) of each slice of the batch's second column."""
    data, offsets = texts(batch.column(1))
    for r0, r1 in slices(offsets):
        base = offsets[r0]
        words = Words(data[base : offsets[r1]], offsets[r0 : r1 + 1] - base, NOT_SPACE)
        yield r0, words, *shingles(words, n)


def signer(n: int, coordinates: int, seed: int):
    """mapInArrow function: (id, text) to (id, n_shingles, two hashes of the word sequence, signature)."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, size=coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    marks = random.integers(0, 1 << 63, size=coordinates, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sizes = np.zeros(rows, dtype=np.int64)
            keys = np.zeros((2, rows), dtype=np.uint64)
            signature = np.zeros((rows, coordinates), dtype=np.uint64)
            for r0, words, hashes, at in slices_of(batch, n):
                full = np.flatnonzero(np.diff(at))
                for r in full:
                    sizes[r0 + r] = len(np.unique(hashes[at[r] : at[r + 1]]))
                # the sequence: order-dependent sums of the words' hashes
                place = mix64(np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], words.count).astype(np.uint64))
                for k in range(2):
                    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64((words.hash + np.uint64(k)) * (place | np.uint64(1))))))
                    keys[k, r0 : r0 + len(words.count)] = sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(np.uint64)
                if len(full):
                    for k in range(coordinates):
                        least = np.minimum.reduceat(hashes * factors[k], at[full])
                        signature[r0 + full, k] = mix64(least ^ marks[k])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(rows + 1, dtype=np.int32) * coordinates), pa.array(signature.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists],
                names=["id", "n_shingles", "k1", "k2", "signature"])

    return sign


def set_maker(n: int):
    """mapInArrow function: (id, text) to (id, distinct shingle hashes, their parities in ``BITS`` cells)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, marks = [], []
            for _, _, hashes, at in slices_of(batch, n):
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = np.unique(hashes[a:b])
                    sets.append(own.view(np.int64))
                    odd = np.bincount((mix64(own) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                    marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * (BITS // 64)),
                                          pa.array(np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64)))],
                names=["id", "shingles", "marks"])

    return make


def posted(tokens: DataFrame, prefix: int, coordinates: int) -> DataFrame:
    """(token, id, weight) of the shared pairs among each text's ``prefix`` rarest ones; the weight says how common its pairs are."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(tokens.join(counts, "token"))
    # Pairs of its own come first in a text's order, then shared ones by their count.
    order = Window.partitionBy("id").orderBy("n", "token")  # at most COORDINATES rows
    own = F.lit(coordinates) - F.count(F.lit(1)).over(Window.partitionBy("id"))
    weight = F.sum(F.log2("n")).over(Window.partitionBy("id"))
    return shared.withColumn("place", own + F.row_number().over(order)).withColumn("weight", weight).where(F.col("place") <= prefix).select(
        "token", "id", "weight")


def confirmed(pairs: DataFrame, known: DataFrame, matches: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that collide in at least ``matches`` coordinates and whose full sets reach the threshold."""
    left = known.select(F.col("id").alias("b"), F.col("signature").alias("v"), F.col("shingles").alias("y"))
    right = known.select(F.col("id").alias("a"), F.col("signature").alias("u"), F.col("shingles").alias("x"))
    collisions = F.size(F.filter(F.zip_with("u", "v", lambda u, v: u == v), lambda same: same))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    both = pairs.join(left, "b").join(right, "a")
    return both.where(collisions >= matches).where(100 * common >= threshold * union).select("a", "b")


def pivots(members: DataFrame, turn: int) -> DataFrame:
    """One pair per member of each list that holds several components: with the list's pivot, or,
    for members of the pivot's own component, with a member of another one. In the first turn the
    pivot is the most central member; later lists choose their
    pivots by hash, so a text that is in many lists meets different others, ``MEETINGS`` of them
    in a round; the rest is not lost but left to ``across``."""
    rank = F.xxhash64(F.lit(turn), "token", "id")
    first = -F.col("weight") if turn == 0 else F.lit(0.0)
    lists = members.groupBy("token").agg(
        F.min(F.struct(first.alias("first"), rank.alias("rank"), "id", "component")).alias("pivot"),
        F.min(F.struct("component", "id")).alias("low"), F.max(F.struct("component", "id")).alias("high"),
    ).where("low.component <> high.component")
    other = F.when(F.col("pivot.component") == F.col("low.component"), F.col("high.id")).otherwise(F.col("low.id"))
    partner = F.when(F.col("component") != F.col("pivot.component"), F.col("pivot.id")).otherwise(other)
    met = members.join(lists, "token").select("id", partner.alias("partner")).distinct()
    turn_of = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(turn), "id", "partner")))  # of at most a text's postings
    return met.withColumn("turn_of", turn_of).where(F.col("turn_of") <= MEETINGS).select("id", "partner")


def across(members: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Pairs of texts of open lists, in different components, that can reach the threshold.

    An exact prefix join on the shingle sets of these texts: with its shingles
    rarest first, a text shares one of its first n - ceil(n * threshold) + 1 with
    every text it is linked to; sizes and the places of the common shingle must
    leave room for the overlap. Shingles of one text alone only take up places.
    What all that lets pass within a group of near copies, whose members share
    most shingles, the parities of the sets hold back inside the join.
    """
    spread = members.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    texts_ = cut(members.join(spread, "token").select("id", "component").distinct())
    rows = cut(known.join(texts_, "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = cut(rows.join(counts, "shingle"))
    inside = Window.partitionBy("id")  # one text's shingles
    place = F.col("n") - F.count(F.lit(1)).over(inside) + F.row_number().over(inside.orderBy("times", "shingle"))
    kept = F.ceil(F.col("n") * threshold / F.lit(100.0))
    posts = cut(shared.withColumn("place", place).where(F.col("place") <= F.col("n") - kept + 1).select("shingle", "id", "component", "n", "place"))
    mixed = posts.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    posts = cut(posts.join(mixed, "shingle").join(known.select("id", "marks"), "id"))
    theirs = posts.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "place", "marks")])
    unlike = F.lit(0)
    for k in range(BITS // 64):
        unlike = unlike + F.bit_count(F.col("marks")[k].bitwiseXOR(F.col("marks2")[k]))
    like = unlike * (100 + threshold) <= (F.col("n") + F.col("n2")) * (100 - threshold)
    overlap = F.ceil((F.col("n") + F.col("n2")) * threshold / F.lit(100.0 + threshold) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    sizes = 100 * F.least("n", "n2") >= threshold * F.greatest("n", "n2")
    return posts.join(theirs, "shingle").where((F.col("component") < F.col("component2")) & sizes & (room >= overlap) & like).select("id", F.col("id2").alias("partner"))


def links(posts: DataFrame, known: DataFrame, matches: int, threshold: int, rounds: int) -> DataFrame | None:
    """Confirmed links (a > b) that connect every component that candidates can connect; None without any."""
    if posts.isEmpty():
        return None
    tested = found = None
    for turn in range(rounds + 1):
        members = posts.withColumn("component", F.col("id"))
        if found is not None:
            members = cut(posts.join(components(found), "id", "left").select("token", "id", F.coalesce("component", "id").alias("component")))
        pairs = pivots(members, turn) if turn < rounds else across(members, known, threshold)
        pairs = pairs.select(F.greatest("id", "partner").alias("a"), F.least("id", "partner").alias("b")).where("a <> b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        # the prefix join on the sets has no need of collisions
        new = cut(confirmed(pairs, known, matches if turn < rounds else 0, threshold))
        tested = pairs if tested is None else tested.unionAll(pairs)
        found = new if found is None else found.unionAll(new)
    return found


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
               coordinates: int = COORDINATES, matches: int = MATCHES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    Words are runs without ASCII white space of the text, A-Z lower-cased.
    Texts are linked when ``threshold`` per cent of the union of their shingle
    sets is common; component_id is the smallest id of the component. A text
    of fewer words than a shingle has its whole sequence as one; NULL and
    empty texts have none and are linked with nothing. Rows that repeat an id
    are reported each; they must repeat the text too. Rows with a NULL id are
    their own component (NULL) and are kept. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(
        signer(shingle, coordinates, SEED), "id long, n_shingles long, k1 long, k2 long, signature array<long>"))
    classes = cut(signed.where("n_shingles > 0 and id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"))
    signatures = signed.where("n_shingles > 0").select("id", "signature").join(reps, "id", "left_semi").dropDuplicates(["id"])
    tokens = signatures.select("id", F.explode("signature").alias("token"))
    posts = cut(posted(tokens, coordinates - matches + 1, coordinates))
    nodes = posts.select("id").distinct()
    sets = rows.join(nodes, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(set_maker(shingle), "id long, shingles array<long>, marks array<long>")
    known = cut(sets.join(signatures.join(nodes, "id", "left_semi"), "id"))
    found = links(posts, known, matches, threshold, rounds)
    linked = classes.withColumn("component", F.col("rep"))
    if found is not None:
        linked = classes.join(components(found), F.col("rep") == F.col("id"), "left").select(
            "k1", "k2", F.coalesce("component", "rep").alias("component"))
    linked = cut(linked.select("k1", "k2", "component"))
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return signed.select("id", "n_shingles", "k1", "k2").join(linked, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
