"""Conversation repair against a brute-force version that compares whole strings of edits."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigie.llm.conversation_repair import BLANK, DUPLICATE, Costs, Repair, audit, damage, repair, repair_report, with_duplicates

from .conftest import CLASHING, SF

SPACES = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, letters, lines) by comparing all strings of edits; rows are (role, text, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for r in "ua":
                if (state, r) in step and (rest := best(i, r, inserts + 1)):
                    found.append((2 + rest[0], "I" + rest[1], (f"{full[r]}:",) + rest[2]))
        if i < len(rows):
            role, text, fault = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((3 + rest[0], "D" + rest[1], rest[2]))
            if fault in (None, "truncated"):
                more = int(fault is not None)
                if (state, role[:1]) in step and (rest := best(i + 1, role[:1], 0)):
                    found.append((more + rest[0], "K" + rest[1], (f"{role}:{text}",) + rest[2]))
                for r in "ua":
                    if (state, r) in step and (rest := best(i + 1, r, 0)):
                        found.append((2 + more + rest[0], "R" + rest[1], (f"{full[r]}:{text}",) + rest[2]))
        return min(found, default=None)

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(table):
    """The whole report of a table of (conv_id, turn, role, text), damage included."""
    held = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        turns = {r[0] for r in rows} - {None}
        told = faults([r[1:] for r in rows])
        cost, letters, lines = cheapest(told)
        count = [f for _, _, f in told].count
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                    illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def edge_table():
    rng = random.Random(11)
    texts = [None, "", "  \n", "Yes.", "Yes. ", "no end", "é?", "a! ", "…", "same.", "same.", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "usher"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in rng.sample(range(-3, 9), rng.randint(1, 6))]
    rows += [(None, t, rng.choice(roles[:3]), rng.choice(texts)) for t in (0, 1, 2, None, None, 5)]
    rows += [(500, None, "user", "Hi."), (500, None, "user", "Hi."), (500, None, "assistant", "Ho.")]
    return rows + [rows[0], rows[0], rows[7]]


def test_report_on_edges(spark):
    rows = edge_table()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHING, "code", "rank", "audit", "present", "kind", "copy"]})
    assert sorted(map(tuple, repair_report(damage(df)).collect()), key=str) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(damage(none)).count() == 0 and repair(none).count() == 0


def test_report_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(map(tuple, repair_report(damage(table)).collect()), key=str) == want


def test_repaired_rows(spark):
    rows = edge_table()
    out = defaultdict(list)
    for r in repair(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect():
        assert r["position"] == len(out[r["conv_id"]])
        out[r["conv_id"]].append((r["role"], r["text"]))
    for conv, lines in out.items():
        initials = "".join(role[0] for role, _ in lines)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and initials != "s", (conv, initials)
        kept = [line for line in lines if line[1]]
        assert len(set(kept)) >= len(kept) - sum(role in ("user", "assistant") for role, _ in kept)  # no copy is kept as it was


code = st.integers(0, 15)


@settings(max_examples=300, deadline=None)
@given(st.lists(code, max_size=9))
def test_audit_equals_brute_force(codes):
    names = {0: None, 1: "blank", 2: "duplicate", 3: "truncated"}
    rows = [(("system", "user", "assistant", "tool")[c // 4], f"t{i}", names[c % 4]) for i, c in enumerate(codes)]
    cost, letters, lines = cheapest(rows)
    assert audit(bytes(codes), Costs()) == (cost, letters)
    applied = Repair(letters)
    got = [f"{role}:{text}" for r, t, _ in rows for _, role, text in applied.row(r, t)]
    assert tuple(got + [f"{role}:{text}" for _, role, text in applied.inserted()]) == lines


def test_long_conversation():
    rng = random.Random(2)
    codes = bytes(rng.choice((4, 8, 4, 8, 0, 5, 7, 11, 12, 6)) for _ in range(30_000))
    cost, letters = audit(codes, Costs())
    # a plain backward program that keeps every row's costs and strings' first letters
    from vigie.llm.conversation_repair import END, costs, edits

    at = [END]
    for c in reversed(codes):
        at.append(costs(c, at[-1]))
    at.reverse()
    state, want, i = 0, [], 0
    while i < len(codes) or at[i][state]:
        moves = [("I", 2 + at[i][(2, 2, 3, 2)[state]], (2, 2, 3, 2)[state])]
        if i < len(codes):
            moves += edits(state, codes[i], at[i + 1])
        letter, _, state = min(m for m in moves if m[1] == at[i][state])
        want.append(letter)
        i += letter != "I"
    assert (cost, letters) == (at[0][0], "".join(want))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), code), max_size=150))
def test_duplicates(rows):
    codes = bytearray(c // 4 * 4 + (BLANK if c % 4 == 1 else 0) for _, c in rows)
    digests = bytearray(b"".join(hashlib.sha256(bytes([d])).digest() for d, _ in rows))
    before = bytes(codes)
    with_duplicates(codes, digests)
    for i, (d, _) in enumerate(rows):
        again = any(rows[j][0] == d for j in range(i)) and before[i] % 4 != BLANK
        assert codes[i] == (before[i] // 4 * 4 + DUPLICATE if again else before[i])
