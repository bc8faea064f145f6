"""Fill-in-the-middle transformation by one counted-quantifier match per text.

``regexp_count`` gives a text's number n of units (a run of white space with
the word after it, or trailing white space). Two hashes of the row's id choose
how many units the prefix (a) and the prefix with the middle (b) hold, and a
pattern written for the row, ``(unit{a}+)(unit{b-a}+)(.*)``, captures prefix,
middle and suffix in one match, whose replacement is the rearranged text. The
quantifiers are possessive, so that the match is a loop that never turns back:
no recursion and linear time, however long the text.

Everything is a Spark expression of the row itself: no shuffle, no Python.

Cases: a NULL text is the empty text, and stays plain; so does a text that
holds one of the markers, since the parts could not be told apart again. Rows
that repeat an id are cut by the same hashes, each at its own length. A NULL id
hashes like the empty text. Further columns, whatever their names, are carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
UNIT = f"{SPACE}*+{WORD}++|{SPACE}++"
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80


def check_markers(markers: Sequence[str]) -> None:
    """Refuse markers that could overlap each other: parts are found again by searching for them."""
    if len(markers) != 3 or len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed: prefix, suffix, middle")
    for a in markers:
        for b in markers:
            if a != b and a in b:
                raise ValueError(f"marker {a!r} lies within {b!r}")
            if any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marker {a!r} may overlap {b!r}")


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the row's SHA-256, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rebuild(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output came from: its parts, found between the markers, in their first order."""
    parts = parts_of(output, markers)
    text = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
    return text.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def parts_of(output: Column, markers: Sequence[str] = MARKERS) -> Column:
    """What stands between the markers of an output: an empty text, then the parts in the output's order."""
    return F.split(output, "|".join(map(re.escape, markers)), -1)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Every row with its units, form, part lengths and transformed text, as the struct ``fim``.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of those
    with the suffix first. ``fim`` holds ``n``, ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` (code points; NULL if plain) and
    ``output``. All columns of ``docs`` are kept; one named ``fim`` is replaced.
    """
    check_markers(markers)
    prefix, suffix, middle = markers
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = _hashes(F.col(f"`{id_col}`"), seed)
    n = F.regexp_count(text, F.lit(UNIT)).cast("long")
    a, b = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    held = text.contains(prefix) | text.contains(suffix) | text.contains(middle)
    form = (F.when((text == "") | held | (h3 % 100 >= rate), F.lit("plain"))
            .when(h4 % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "fim"]).alias("row"),
                       text.alias("text"), n.alias("n"), a.alias("a"), b.alias("b"), form.alias("form"))
    units = F.lit(f"((?:{UNIT}){{")
    pattern = F.concat(F.lit(r"(?s)\A"), units, F.col("a").cast("string"), F.lit("}+)"),
                       units, (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*+)\z"))
    dollar = lambda s: s.replace("\\", r"\\").replace("$", r"\$")
    layout = (F.when(F.col("form") == "psm", F.lit(f"{dollar(prefix)}$1{dollar(suffix)}$3{dollar(middle)}$2"))
              .otherwise(F.lit(f"{dollar(suffix)}$3{dollar(prefix)}$1{dollar(middle)}$2")))
    cut = rows.select("row", "n", "form", F.when(F.col("form") == "plain", F.col("text"))
                      .otherwise(F.regexp_replace("text", pattern, layout)).alias("output"))
    parts = parts_of(F.col("output"), markers)
    told = F.col("form") != "plain"
    fim = F.struct(
        "n", "form",
        F.when(told, F.char_length(F.when(F.col("form") == "psm", parts[1]).otherwise(parts[2])).cast("long")).alias("prefix_chars"),
        F.when(told, F.char_length(parts[3]).cast("long")).alias("middle_chars"),
        "output")
    return cut.select("row.*", fim.alias("fim"))


def fim_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: units, form, part lengths, digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"), **options)
    markers = options.get("markers", MARKERS)
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                      F.sha2("fim.output", 256).alias("output_sha256"),
                      F.sha2(rebuild(F.col("fim.output"), F.col("fim.form"), markers), 256).alias("restored_sha256"))
