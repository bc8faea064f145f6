"""Cell-block extraction on a hand-made workbook (the reference's layouts)."""

import datetime as dt

from vigie import operators as O
from vigie.plans import composed as P

from .conftest import rows


def _cells(spark, items):
    return spark.createDataFrame(items, "workbook string, sheet_index int, sheet string, row int, col int, value string")


def _age_workbook(spark):
    """Two workbooks, sheet 2 with 2 age rows (8-9) and 2 day blocks (stride 7)."""
    items = []
    for wb, shift in (("w1", 0.0), ("w2", 10.0)):
        items += [(wb, 1, "notes", 1, 1, "x"),
                  (wb, 2, "s", 7, 1, "Age Group"), (wb, 2, "s", 8, 1, "0-59"), (wb, 2, "s", 9, 1, "60+"),
                  (wb, 2, "s", 6, 8, "2020-04-06"), (wb, 2, "s", 6, 15, "2020-04-05"),
                  (wb, 2, "s", 8, 14, str(12.34 + shift)), (wb, 2, "s", 9, 14, str(87.66 - shift)),
                  (wb, 2, "s", 8, 21, "11.05"), (wb, 2, "s", 9, 21, "88.95"),
                  # a block body without a date (dropped) and an unrelated cell
                  (wb, 2, "s", 8, 28, "5"), (wb, 2, "s", 8, 16, "zz")]
    return _cells(spark, items)


def test_a1_range():
    assert O.a1_range("A5:H35") == (5, 35, 1, 8)
    assert O.a1_range("H6") == (6, 6, 8, 8)
    assert O.a1_range("AA1:AB2") == (1, 2, 27, 28)


def test_cell_range_types_and_missing(spark):
    c = _cells(spark, [("w", 2, "22", 5, 1, "2020-03-01"), ("w", 2, "22", 5, 2, "12"),
                       ("w", 2, "22", 6, 1, "2020-03-02"), ("w", 2, "22", 6, 2, "n/a")])
    out = O.cell_range(c, (5, 6), (1, 2), ["date", "total"], ["date", "numeric"])
    assert rows(out, "date", "total") == [(dt.date(2020, 3, 1), 12.0), (dt.date(2020, 3, 2), None)]


def test_cell_and_sheet_range_by_name_or_index(spark):
    c = _cells(spark, [("w", 2, "22", 5, 1, "1"), ("w", 3, "29", 5, 1, "2")])
    assert rows(O.cell(c, 5, 1, sheet="29"), "value") == [("2",)]
    assert rows(O.sheet_range(c, 2, "A5:A5", ["v"], ["numeric"]), "v") == [(1.0,)]


def test_strided_blocks(spark):
    wb = _age_workbook(spark).where("workbook = 'w1'")
    b = O.strided_blocks(wb, (8, 9), 14, 7)
    assert rows(b, "block", "row", "value") == [(0, 8, "12.34"), (0, 9, "87.66"), (1, 8, "11.05"),
                                               (1, 9, "88.95"), (2, 8, "5")]
    assert O.strided_blocks(wb, (8, 9), 14, 7, n_blocks=1).count() == 2


def test_age_share_by_day_many_workbooks(spark):
    out = P.age_share_by_day(_age_workbook(spark).where("workbook = 'w1'"), ["0-59", "60+"], workbook="w1",
                             label_rows=(8, 9))
    # sorted on the real date, formatted after; the dateless block is dropped;
    # 11.05 and 88.95 are stored a little above their texts
    assert [tuple(r) for r in out.collect()] == [("w1", "05/04", 11.1, 89.0), ("w1", "06/04", 12.3, 87.7)]
    w2 = P.age_share_by_day(_age_workbook(spark), ["0-59", "60+"], workbook="w2", label_rows=(8, 9))
    assert rows(w2, "date", "0-59") == [("05/04", 11.1), ("06/04", 22.3)]


def test_age_share_latest(spark):
    out = P.age_share_latest(_age_workbook(spark), workbook="w1", label_rows=(8, 9))
    assert rows(out, "groupe_age", "date", "part") == [("0-59", "06/04", 12.3), ("60+", "06/04", 87.7)]


def test_sheets_to_table_skips_first_sheet(spark):
    c = _cells(spark, [("w", 1, "France", 5, 1, "2020-03-01"), ("w", 1, "France", 5, 2, "100"),
                       ("w", 2, "22", 5, 1, "2020-03-01"), ("w", 2, "22", 5, 2, "3"),
                       ("w", 3, "29", 5, 1, "2020-03-01"), ("w", 3, "29", 5, 2, "4")])
    out = O.sheets_to_table(c, (5, 65), (1, 2), ["date", "total2020"], ["date", "numeric"])
    assert rows(out, "dep", "total2020") == [("22", 3.0), ("29", 4.0)]


def test_cell_range_refuses_a_cell_address_given_twice(spark):
    import pytest

    c = _cells(spark, [("w", 2, "22", 5, 1, "1"), ("w", 2, "22", 5, 1, "2")])
    with pytest.raises(Exception, match="several values for one cell"):
        O.cell_range(c, (5, 5), (1, 1), ["v"]).collect()


def test_date_cells_accept_iso_text_and_serial_numbers(spark):
    c = _cells(spark, [("w", 2, "s", 5, 1, "2020-04-06"), ("w", 2, "s", 6, 1, "43927"),
                       ("w", 2, "s", 7, 1, "43927.75"), ("w", 2, "s", 8, 1, "n/a"),
                       ("w", 2, "s", 9, 1, "2020-04-06 00:00:00"), ("w", 2, "s", 10, 1, "2020-04-06T12:00:00")])
    out = O.cell_range(c, (5, 10), (1, 1), ["d"], ["date"])
    day = dt.date(2020, 4, 6)
    assert {r.row: r.d for r in out.collect()} == {5: day, 6: day, 7: day, 8: None, 9: day, 10: day}
