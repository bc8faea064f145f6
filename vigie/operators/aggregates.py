"""Aggregations with the reference's NA rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.missing import na_sum, present, strict_sum
from ..functions.numbers import round_even


def grouped_sums(
    df: DataFrame,
    by: Sequence[str],
    measures: Sequence[str] | dict[str, str],
    na_rm: bool = False,
) -> DataFrame:
    """``group_by(by) %>% summarize(x = sum(x), ...)`` (A1, A2).

    ``na_rm=False``: NULL if any member is NULL (Q3); ``na_rm=True``: NULLs
    skipped, all-NULL groups give 0 (Q4). ``measures`` may map output -> input.
    """
    if not isinstance(measures, dict):
        measures = {m: m for m in measures}
    agg = na_sum if na_rm else strict_sum
    return df.groupBy(*by).agg(*[agg(F.col(f"`{src}`")).alias(out) for out, src in measures.items()])


def fixed_window_mean(df: DataFrame, by: Sequence[str], measure: str, n_days: int, out: str) -> DataFrame:
    """``round(sum(x) / n_days)``: divides by the window length even when days are missing (A3, Q23)."""
    return df.groupBy(*by).agg(round_even(strict_sum(F.col(measure)) / F.lit(float(n_days))).alias(out))


def peak(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Peak and last date of a series in one global aggregate.

    Missing values (NULL, NaN) are skipped. Returns one row: ``peak_value``,
    ``peak_date`` (earliest date on ties),
    ``last_date`` and ``last_label`` (``%d %b`` in French).
    """
    d, v = F.col(date_col), F.when(present(value_col), F.col(value_col))
    out = df.agg(
        F.max(v).alias("peak_value"),
        F.min_by(d, F.when(v.isNotNull(), F.struct(-v, d))).alias("peak_date"),
        F.max(d).alias("last_date"),
    )
    return out.withColumn("last_label", month_label("last_date", short=True))
