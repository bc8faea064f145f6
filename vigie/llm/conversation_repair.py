"""Conversation structure repair by a square-root checkpointed dynamic program.

A repaired conversation's role initials read ``(s?(ua)+)?``: an automaton of
four states (start, after system, after user, after assistant) in which every
state allows one of user and assistant next, so that a string of edits (Keep,
Rerole, Delete, Insert) fixes the result. ``V_i(q)`` is the least cost of what
follows row i in state q. A backward pass over the rows stores these four costs
only at every ``ceil(sqrt(n))``-th row; walking forward, each block's costs are
computed again from the checkpoint behind it, and the ASCII-least edit that
keeps the cost tight is emitted.

A conversation's rows come to one task, since its audit is one text and its
digest a SHA-256 over its rows in order, which nothing can split. They stream
through that task sorted and are never collected. First a code and a digest of
every row (no text) are dealt by conversation: the task holds about 40 bytes a
row of one conversation, as its audit holds a letter a row. Then audits and rows
are dealt once more, and the texts stream past their audit, a batch at a time.

Cases: NULL texts and roles count as one space. Rows are taken by turn, NULLs
first; rows of one turn by the digest of role and text, so that copies stand
together. A NULL conversation id is a conversation of its own. Roles other than
system, user and assistant are told by their first letter alone; an empty role
has none. Only the columns named are used, so that no other can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
# classes of a row's first letter, and its fault
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# states: nothing yet, after system, after user, after assistant
AFTER_USER, AFTER_ASSISTANT = 2, 3
NEEDED = (2, 2, 3, 2)  # the state after the one role of user and assistant that a state allows
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # by state and class
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RECAST, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
END = (0, 4, 2, 0)  # costs behind the last row: what is missing is inserted
ROLE = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}


# ------------------------------------------------------------------ the dynamic program

def edits(state: int, code: int, behind: tuple) -> list[tuple[str, int, int]]:
    """A row's edits in ASCII order: letter, cost up to the end, next state."""
    kind, fault = divmod(code, 4)
    out = [("D", DELETE + behind[state], state)]
    if fault in (FINE, TRUNCATED):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        kept = KEPT[state][kind]
        if kept is not None:
            out.append(("K", more + behind[kept], kept))
        out.append(("R", RECAST + more + behind[NEEDED[state]], NEEDED[state]))
    return out


def costs(code: int, behind: tuple) -> tuple:
    """The four costs before a row from those behind it."""
    own = [min(cost for _, cost, _ in edits(q, code, behind)) for q in range(4)]
    user, assistant = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + user), min(own[1], INSERT + user), user, assistant


class Costs:
    """``costs`` with a table of what it gave: differences of costs are bounded, so it stays small."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def __call__(self, code: int, behind: tuple) -> tuple:
        low = behind[0]
        key = (code, behind[1] - low, behind[2] - low, behind[3] - low)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = costs(code, (0, *key[1:]))
        return got[0] + low, got[1] + low, got[2] + low, got[3] + low


def audit(codes: bytes, step: Costs) -> tuple[int, str]:
    """Cost and ASCII-least letters of a cheapest repair; ``codes`` are 4 * class + fault of every row."""
    n = len(codes)
    block = isqrt(n) + 1
    at, marks = END, {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0:
            marks[i + 1] = at
        at = step(codes[i], at)
    total, state, letters = at[0], 0, bytearray()
    for start in range(0, n, block):
        stop = min(start + block, n)
        held = [marks[stop] if stop < n else END]
        for i in range(stop - 1, start - 1, -1):
            held.append(step(codes[i], held[-1]))
        held.reverse()
        for i in range(start, stop):
            here, behind = held[i - start], held[i - start + 1]
            while True:
                best = here[state]
                tight = [(letter, after) for letter, cost, after in edits(state, codes[i], behind) if cost == best]
                if tight and tight[0][0] == "D":
                    letters += b"D"
                    break
                if INSERT + here[NEEDED[state]] == best:
                    letters += b"I"
                    state = NEEDED[state]
                    continue
                letter, state = tight[0]
                letters += letter.encode()
                break
    letters += b"I" * (END[state] // INSERT)
    return total, letters.decode()


class Repair:
    """Applies an audit to the rows that come past: the rows of the repaired conversation."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEEDED[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][kind_of(role)]
            yield letter, role, text
        elif letter == "R":
            self.state = NEEDED[self.state]
            yield letter, ROLE[self.state], text


def kind_of(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def with_duplicates(codes: bytearray, digests: bytearray) -> None:
    """Mark rows whose digest an earlier one has, unless they are blank."""
    n = len(codes)
    if n < 64:
        seen = set()
        for i in range(n):
            digest = bytes(digests[32 * i:32 * i + 32])
            if digest in seen and codes[i] % 4 != BLANK:
                codes[i] = codes[i] // 4 * 4 + DUPLICATE
            seen.add(digest)
        return
    keys = np.frombuffer(digests, dtype=">u8").reshape(n, 4)
    order = np.lexsort((np.arange(n), keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    again = np.zeros(n, bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    own = np.frombuffer(codes, dtype=np.uint8)
    marked = np.where(again & (own % 4 != BLANK), own // 4 * 4 + DUPLICATE, own)
    codes[:] = marked.astype(np.uint8).tobytes()


# ------------------------------------------------------------------ streams

def _runs(ids: pa.Array) -> list[tuple[int, int]]:
    """Stretches of equal ids."""
    values = ids.to_pylist()
    cuts = [0, *[k for k in range(1, len(values)) if values[k] != values[k - 1]], len(values)]
    return list(zip(cuts, cuts[1:]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    def __init__(self):
        self.codes, self.digests = bytearray(), bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, turns, codes, digests) -> None:
        for turn, code, digest in zip(turns, codes, digests):
            if code is None:  # a row that only says that the conversation exists
                continue
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1
            self.codes.append(code)
            self.digests += digest

    def result(self, step: Costs) -> dict:
        with_duplicates(self.codes, self.digests)
        faults = [code % 4 for code in self.codes]
        kinds = [code // 4 for code in self.codes]
        cost, letters = audit(bytes(self.codes), step)
        return {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": faults.count(BLANK),
                "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(pair not in LEGAL for pair in zip(kinds, kinds[1:])), "cost": cost, "audit": letters}


def _audits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    step, current, now, rows = Costs(), None, None, []

    def out():
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        ids = batch.column("conv_id")
        turns, codes, digests = (batch.column(c).to_pylist() for c in ("turn", "code", "digest"))
        for a, b in _runs(ids):
            key = ids[a].as_py()
            if current is None or key != now:
                if current is not None:
                    rows.append({"conv_id": now, **current.result(step)})
                current, now = _Conversation(), key
            current.add(turns[a:b], codes[a:b], digests[a:b])
        if len(rows) > 1000:
            yield out()
            rows = []
    if current is not None:
        rows.append({"conv_id": now, **current.result(step)})
    if rows:
        yield out()


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema, hashed: bool) -> Iterator[pa.RecordBatch]:
    """Every audit's conversation: its digest, or its repaired rows."""
    head, repair, digest, place, rows, held = None, None, None, 0, [], 0

    def put(lines):
        nonlocal place, held
        for letter, role, text in lines:
            if hashed:
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            else:
                rows.append({"conv_id": head["conv_id"], "position": place, "edit": letter, "role": role, "text": text})
                held += len(text) + 100
            place += 1

    def finish():
        if head is not None:
            put(repair.inserted())
            if hashed:
                rows.append({**head, "repaired_sha256": digest.hexdigest()})

    def out():
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        audits, roles, texts = (batch.column(c) for c in ("audit", "role", "text"))
        for k in range(batch.num_rows):
            letters = audits[k].as_py()
            if letters is not None:
                finish()
                head = {c: batch.column(c)[k].as_py() for c in ("conv_id", *COUNTS, "audit")}
                repair, digest, place = Repair(letters), hashlib.sha256(), 0
            else:
                put(repair.row(roles[k].as_py(), texts[k].as_py()))
            if len(rows) > 1000 or held > 16 << 20:
                yield out()
                rows, held = [], 0
    finish()
    if rows:
        yield out()


# ------------------------------------------------------------------ frames

def damage(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with known faults; ``present`` is false where a row is dropped.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _rows(conversations: DataFrame) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"),
                                present.alias("present"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumn("digest", F.when(F.col("present"), digest))


def _audited(rows: DataFrame) -> DataFrame:
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(*ENDS), FINE).otherwise(TRUNCATED)
    coded = rows.select("conv_id", "turn", F.when(F.col("present"), 4 * kind + fault).alias("code"), "digest")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("audit", T.StringType())])
    arrow = _arrow(schema)
    return dealt.mapInArrow(lambda batches: _audits(batches, arrow), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _past_audits(rows: DataFrame, schema: T.StructType, hashed: bool) -> DataFrame:
    """Audits and rows dealt by conversation, every audit before its rows."""
    arrow = _arrow(schema)
    both = _audited(rows).withColumn("rank", F.lit(0)).unionByName(
        rows.where("present").drop("present").withColumn("rank", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "rank", F.col("turn").asc_nulls_first(), "digest")
    return dealt.mapInArrow(lambda batches: _repaired(batches, arrow, hashed), schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Per conversation: faults, cost, the edits' letters, and the SHA-256 of the repaired ``role:text`` lines.

    A boolean column ``present`` marks rows to leave out; their conversations
    are reported all the same.
    """
    rows = _rows(conversations)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _past_audits(rows, schema, True)


def repair(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position from 0, edit (K, R or I), role, text."""
    rows = _rows(conversations)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("position", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    return _past_audits(rows, schema, False)
