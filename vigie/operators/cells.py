"""Spreadsheet cell blocks as relations.

Input is a long ``cells`` table (workbook, sheet_index, sheet, row, col,
value) with 1-based rows and columns and text values. Every operator is a
filter on (row, col) plus a grouped conditional aggregation, so any number
of workbooks and sheets is processed in one pass with no driver loop.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date

SHEET_KEYS = ("workbook", "sheet_index", "sheet")


def _sheet_filter(sheet) -> Column:
    if sheet is None:
        return F.lit(True)
    if isinstance(sheet, int):
        return F.col("sheet_index") == sheet
    return F.col("sheet") == sheet


# Fixed value: day 0 of spreadsheet date serial numbers (the 1900 date system,
# exact for every date from 1 March 1900 on).
SERIAL_EPOCH = "1899-12-30"


def convert(value: Column, typ: str) -> Column:
    """Text cell -> typed value; unconvertible text gives NULL (readxl's NA).

    ``"date"`` takes ISO text (a time part, as in ``2020-04-06 00:00:00``, is
    dropped) or a spreadsheet date serial number.
    """
    if typ == "text":
        return value
    if typ == "date":
        serial = value.try_cast("double")
        from_serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(serial).cast("int"))
        with_time = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), parse_date(F.substring(value, 1, 10)))
        return F.coalesce(parse_date(value), with_time, F.when(serial.isNotNull(), from_serial))
    if typ in ("numeric", "double"):
        return value.try_cast("double")
    return value.try_cast(typ)


def a1_range(spec: str) -> tuple[int, int, int, int]:
    """``"A5:H35"`` -> (row0, row1, col0, col1), 1-based inclusive."""
    m = re.fullmatch(r"([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?", spec.strip().upper())
    if not m:
        raise ValueError(f"bad cell range {spec!r}")

    def col_no(letters: str) -> int:
        n = 0
        for ch in letters:
            n = n * 26 + (ord(ch) - 64)
        return n

    c0, r0 = col_no(m.group(1)), int(m.group(2))
    c1, r1 = (col_no(m.group(3)), int(m.group(4))) if m.group(3) else (c0, r0)
    return r0, r1, c0, c1


def cell_range(
    cells: DataFrame,
    rows: tuple[int, int],
    cols: tuple[int, int],
    names: Sequence[str],
    types: Sequence[str] | None = None,
    sheet=None,
    keys: Sequence[str] = SHEET_KEYS,
) -> DataFrame:
    """Rectangular range -> one row per sheet row, one column per cell column.

    Output: ``keys``, ``row``, then ``names`` typed by ``types``.
    Rows where no cell of the range exists are absent.
    """
    r0, r1 = rows
    c0, c1 = cols
    if len(names) != c1 - c0 + 1:
        raise ValueError("one name per column of the range")
    types = list(types) if types is not None else ["text"] * len(names)
    block = cells.where(
        _sheet_filter(sheet)
        & F.col("row").between(r0, r1)
        & F.col("col").between(c0, c1)
    )
    # One conditional maximum per column (partial before the shuffle). A cell
    # address that occurs twice raises.
    def at(i: int) -> Column:
        here = F.col("col") == c0 + i
        twice = F.raise_error(F.lit(f"cell_range: several values for one cell of {names[i]}")).cast("string")
        return F.when(F.count_if(here) > 1, twice).otherwise(F.max(F.when(here, F.col("value"))))

    by_row = block.groupBy(*keys, "row").agg(*[at(i).alias(f"__c{i}") for i in range(len(names))])
    return by_row.select(*keys, "row", *[convert(F.col(f"__c{i}"), t).alias(n) for i, (n, t) in enumerate(zip(names, types))])


def cell(cells: DataFrame, row: int, col: int, name: str = "value", typ: str = "text",
         sheet=None, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """One cell per sheet -> (keys, name)."""
    return cells.where(_sheet_filter(sheet) & (F.col("row") == row) & (F.col("col") == col)).select(
        *keys, convert(F.col("value"), typ).alias(name)
    )


def strided_blocks(
    cells: DataFrame,
    rows: tuple[int, int],
    first_col: int,
    stride: int,
    n_blocks: int | None = None,
    sheet=None,
    keys: Sequence[str] = SHEET_KEYS,
) -> DataFrame:
    """The same column range repeated every ``stride`` columns.

    Output: keys, ``block`` (0-based), ``row``, ``value`` for the columns
    ``first_col + stride * block``. ``n_blocks=None`` takes every block present.
    """
    offset = F.col("col") - F.lit(first_col)
    cond = (
        _sheet_filter(sheet)
        & F.col("row").between(*rows)
        & (offset >= 0)
        & (F.pmod(offset, F.lit(stride)) == 0)
    )
    out = cells.where(cond).select(*keys, (offset / stride).cast("int").alias("block"), "row", "value")
    if n_blocks is not None:
        out = out.where(F.col("block") < n_blocks)
    return out


def join_block_header(body: DataFrame, header: DataFrame, name: str, typ: str = "text",
                      keys: Sequence[str] = SHEET_KEYS, keep_unheaded: bool = False) -> DataFrame:
    """Attach each block's header cell to the block's rows (C4).

    Blocks without a header are dropped (a day without a date is no day);
    ``keep_unheaded`` keeps them, with a NULL header.
    """
    h = header.select(*keys, "block", convert(F.col("value"), typ).alias(name)).where(F.col(name).isNotNull())
    return body.join(h, on=[*keys, "block"], how="left" if keep_unheaded else "inner")


def bind_by_row(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*SHEET_KEYS, "row"),
                how: str = "inner") -> DataFrame:
    """Positional ``bind_cols`` made explicit: rows correspond by sheet row number."""
    return left.join(right, on=list(keys), how=how)


def sheets_to_table(
    cells: DataFrame,
    rows: tuple[int, int],
    cols: tuple[int, int],
    names: Sequence[str],
    types: Sequence[str],
    skip_first: int = 1,
    tag: str = "dep",
) -> DataFrame:
    """Every sheet after the first ``skip_first``, same range, tagged by sheet name."""
    body = cell_range(cells.where(F.col("sheet_index") > skip_first), rows, cols, names, types)
    return body.select(F.col("workbook"), F.col("sheet").alias(tag), "row", *names)


def sheet_range(cells: DataFrame, sheet, spec: str, names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """One sheet (by index or name) and an A1 range with declared names and types."""
    r0, r1, c0, c1 = a1_range(spec)
    return cell_range(cells, (r0, r1), (c0, c1), names, types, sheet=sheet)
