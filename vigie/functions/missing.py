"""Missing values, sums and ratios with the reference's NA rules.

* ``present``: NA test that is also true for NaN (Q1).
* ``strict_sum``: a sum that is NULL as soon as one input is NULL (Q3).
* ``na_sum``: a sum that skips NULL and NaN and gives 0 for a group without a value (Q4).
* ``r_divide``: IEEE division, ``x/0 = +-Infinity``, ``0/0 = NaN`` (Q6),
  without tripping ANSI mode's division-by-zero error.
* ``safe_ratio``: ``r_divide`` where ``0/0`` becomes 0 (M7).
* ``pct_change``: ``(new - old) / old * 100`` with the results of ``r_divide`` (M3).
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ._util import col

_INF = float("inf")
_NAN = float("nan")


def present(c: Column | str) -> Column:
    """True when the value is neither NULL nor NaN (R ``!is.na``); for numeric columns."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c)


def missing(c: Column | str) -> Column:
    """R ``is.na``: NULL or NaN."""
    return ~present(c)


def fill(c: Column | str, value=0) -> Column:
    """Replace NULL and NaN by ``value`` (``nafill`` / ``replace_na``); for numeric columns."""
    return F.when(present(c), col(c)).otherwise(F.lit(value))


def _over(agg: Column, window: WindowSpec | None) -> Column:
    return agg if window is None else agg.over(window)


def strict_sum(c: Column | str, window: WindowSpec | None = None) -> Column:
    """Sum that is NULL when any input row is NULL (R ``sum`` without na.rm).

    Built from two counts and a sum, so it stays a partial/final aggregate
    (map-side combine) like a plain ``sum``.
    """
    c = col(c)
    complete = _over(F.count(c), window) == _over(F.count(F.lit(1)), window)
    return F.when(complete, _over(F.sum(c), window))


def na_sum(c: Column | str, window: WindowSpec | None = None) -> Column:
    """Sum skipping NULL and NaN; a group with nothing else sums to 0."""
    return F.coalesce(_over(F.sum(F.when(present(c), col(c))), window), F.lit(0))


def r_divide(num: Column | str, den: Column | str) -> Column:
    """Floating division with IEEE results for a zero denominator."""
    num = col(num).cast("double")
    den = col(den).cast("double")
    by_zero = (
        F.when(F.isnan(num), F.lit(_NAN))    # Spark orders NaN above every number
        .when(num > 0, F.lit(_INF))
        .when(num < 0, F.lit(-_INF))
        .when(num.isNotNull(), F.lit(_NAN))
    )
    return F.when(den == 0, by_zero).otherwise(num / den)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``r_divide`` where 0/0 gives 0 instead of NaN; x/0 stays Infinity."""
    num = col(num)
    den = col(den)
    return F.when((den == 0) & (num == 0), F.lit(0.0)).otherwise(r_divide(num, den))


def pct_change(new: Column | str, old: Column | str) -> Column:
    """Percent change ``(new - old) / old * 100``; infinite or NaN when ``old`` is 0, as ``r_divide``."""
    new = col(new).cast("double")
    old = col(old).cast("double")
    return r_divide(new - old, old) * F.lit(100.0)
