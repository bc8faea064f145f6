"""Date parsing and formatting, including French month names (Q16).

The host locale is never consulted: month names come from the fixed lists
below, so output is the same on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# French month names, January to December, as printed by
# strftime %B / %b under a fr_FR locale.
MONTHS_FR = [
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
]
MONTHS_FR_SHORT = [
    "janv.", "févr.", "mars", "avr.", "mai", "juin",
    "juil.", "août", "sept.", "oct.", "nov.", "déc.",
]


def parse_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to DATE; unparsable text gives NULL instead of an ANSI error."""
    return F.try_to_date(col(c).cast("string"), fmt)


def parse_day_month(c: Column | str, year: int | Column) -> Column:
    """``dd/MM`` text to a DATE in ``year`` (D2). The year is explicit: R takes
    the current year (Q15); pipelines keep the full DATE and format last."""
    y = year if isinstance(year, Column) else F.lit(year)
    return F.try_to_date(F.concat(col(c).cast("string"), F.lit("/"), y.cast("string")), "dd/MM/yyyy")


def month_name(c: Column | str, short: bool = False) -> Column:
    names = MONTHS_FR_SHORT if short else MONTHS_FR
    return F.element_at(F.array(*[F.lit(m) for m in names]), F.month(col(c)))


def month_label(c: Column | str, short: bool = False) -> Column:
    """``format(d, "%d %B")`` in French: ``24 juillet``; ``short`` gives ``24 juil.``."""
    d = col(c)
    return F.concat(F.date_format(d, "dd"), F.lit(" "), month_name(d, short))


def day_month(c: Column | str) -> Column:
    """``format(d, "%d/%m")``."""
    return F.date_format(col(c), "dd/MM")


def day_month_year(c: Column | str) -> Column:
    """``dd/MM/yyyy`` (day, month, year padded and joined by '/')."""
    return F.date_format(col(c), "dd/MM/yyyy")


def date_minus(c: Column | str, days: int) -> Column:
    return F.date_sub(col(c), days)


def stamp(as_of: Column | str) -> Column:
    """``format(Sys.time(), "%d %B, %Hh")`` for an explicit ``as_of`` timestamp."""
    ts = col(as_of)
    return F.concat(month_label(ts), F.lit(", "), F.date_format(ts, "HH"), F.lit("h"))


def as_of_or_now(as_of=None) -> Column:
    """The run timestamp: ``as_of`` when given (reproducible), else now."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp")
