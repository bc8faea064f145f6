"""Text helpers: padding, recoding, sentences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, lit_or_col


def pad_left(c: Column | str, width: int, pad: str = "0") -> Column:
    """Left pad to ``width``; never shortens a longer value (Q8, ``str_pad``)."""
    s = col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, pad)).otherwise(s)


def recode(c: Column | str, mapping: Mapping, keep: bool = True) -> Column:
    """Replace values found in ``mapping``.

    ``keep=True`` keeps unmatched values (``case_when(..., TRUE ~ x)``),
    ``keep=False`` turns them into NULL.
    """
    c = col(c)
    if not mapping:
        return c if keep else F.lit(None).cast("string")
    items = list(mapping.items())
    out = F.when(c == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(c) if keep else out


def sentence(*parts) -> Column:
    """Concatenate literal text and columns without separator (``paste0``).

    A NULL part makes the whole sentence NULL (Q9); callers guard with
    ``when`` the way the reference does. Pass numbers through ``number_text``
    to print them as R does (a plain cast writes ``1.0`` for 1).
    """
    return F.concat(*[lit_or_col(p).cast("string") for p in parts])


def join_text(sep: str, *parts) -> Column:
    """Concatenate with a separator (``paste(..., sep=)``).

    Like ``sentence``, a NULL part makes the result NULL (Q9) instead of R's
    literal ``NA`` text.
    """
    cols = [lit_or_col(p).cast("string") for p in parts]
    with_seps = [x for c in cols for x in (F.lit(sep), c)][1:]
    return F.concat(*with_seps)


def substring_between(c: Column | str, first: int, last: int) -> Column:
    """1-based inclusive substring, as R ``substring(x, first, last)``."""
    return F.substring(col(c).cast("string"), first, last - first + 1)


# What a one-byte charset can have decoded to.
ONE_BYTE = {"ISO-8859-1": r"^[\x00-\xFF]*$", "US-ASCII": r"^[\x00-\x7F]*$"}


def encode_repair(c: Column | str, wrong: str = "ISO-8859-1", right: str = "UTF-8") -> Column:
    """Undo text that was decoded with the wrong charset, value by value.

    A text is repaired where its re-encoded bytes are a text of the right
    charset: one that was read correctly keeps its characters, since accents
    alone are no valid UTF-8, and so does one with characters that the wrong
    charset does not have. (Text that spells out the wrong reading, such as
    ``Ã©`` meant as such, cannot be told from it.) Normal pipelines decode at
    the scan instead (``scan_csv(encoding=...)``).
    """
    text = col(c)
    if wrong.upper() not in ONE_BYTE or right.upper() != "UTF-8":
        raise ValueError("encode_repair undoes UTF-8 that was read as ISO-8859-1 or US-ASCII")
    raw = F.encode(text, wrong)
    return (F.when(text.isNull() | ~text.rlike(f"(?s){ONE_BYTE[wrong.upper()]}"), text)
            .when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, right)).otherwise(text))
