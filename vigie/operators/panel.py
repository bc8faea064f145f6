"""Area x day panel operators.

``latest`` / ``trailing_days`` compare each row's date with a global maximum
computed as an uncorrelated scalar subquery (partial + final max, one value),
never as a window over the whole table (which would move every row to one
partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import present, strict_sum
from .ordered import differences


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    """``filter(!is.na(x))`` for each column: NULL is dropped, and NaN too for
    floating columns (other types have no NaN)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cond = None
    for c in cols:
        floating = isinstance(types.get(c), (T.DoubleType, T.FloatType))
        p = present(F.col(f"`{c}`")) if floating else F.col(f"`{c}`").isNotNull()
        cond = p if cond is None else cond & p
    return df if cond is None else df.where(cond)


def max_of(df: DataFrame, col: str) -> Column:
    """Global maximum of ``col`` as a scalar-subquery Column."""
    return df.agg(F.max(F.col(f"`{col}`"))).scalar()


def latest(df: DataFrame, date_col: str) -> DataFrame:
    """Rows at the latest date of ``df`` (F6): ``filter(d == max(d))``."""
    return df.where(F.col(f"`{date_col}`") == max_of(df, date_col))


def trailing_days(
    df: DataFrame,
    date_col: str,
    n_days: int = 7,
    anchor: DataFrame | None = None,
    anchor_col: str | None = None,
) -> DataFrame:
    """Keep ``d > max(d) - n_days``.

    ``anchor`` is the frame the maximum is taken over. ``None`` means ``df``
    itself, so filters applied before the call also restrict the maximum (F7);
    pass the unfiltered input to take the maximum over all rows (comma
    conditions in one filter, F8, Q13).
    """
    bound = max_of(anchor if anchor is not None else df, anchor_col or date_col)
    return df.where(F.col(f"`{date_col}`") > F.date_sub(bound, n_days))


def with_comparator(df: DataFrame, comparator: DataFrame, on: str | Sequence[str] = "extract_date",
                    na_matches: str = "na") -> DataFrame:
    """Left join a comparator series (one row per key) onto detail rows (J1); NULL keys match unless told otherwise."""
    return join_on(df, comparator, [on] if isinstance(on, str) else on, "left", na_matches)


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | dict,
    how: str = "left",
    na_matches: str = "never",
    suffix: tuple[str, str] = (".x", ".y"),
) -> DataFrame:
    """Equi-join with dplyr key handling.

    ``keys``: same-named keys as a list, or ``{left_name: right_name}``.
    One key column is returned under the left name; for a right join it
    carries the right side's value, for a full join the non-NULL one.
    ``na_matches="na"`` lets NULL match NULL (``eqNullSafe``), which is still a
    hashable equi-join key for sort-merge and broadcast-hash joins.
    Other columns present on both sides are kept, with ``suffix`` appended.
    """
    if not isinstance(keys, dict):
        keys = {k: k for k in keys}
    if na_matches not in ("never", "na"):
        raise ValueError("na_matches must be 'never' or 'na'")
    if how not in ("left", "right", "inner", "full"):
        raise ValueError(f"unsupported join type {how}")
    tmp = {r: f"__rk_{i}" for i, r in enumerate(keys.values())}
    r2 = right.withColumnsRenamed(tmp)
    cond = None
    for lk, rk in keys.items():
        lc, rc = left[f"`{lk}`"], r2[f"`{tmp[rk]}`"]
        c = lc.eqNullSafe(rc) if na_matches == "na" else lc == rc
        cond = c if cond is None else cond & c
    joined = left.join(r2, cond, how)
    right_rest = [c for c in r2.columns if c not in tmp.values()]
    both = {c for c in right_rest if c in left.columns and c not in keys}
    out = []
    for name in left.columns:
        if name in keys:
            lc, rc = left[f"`{name}`"], r2[f"`{tmp[keys[name]]}`"]
            key = {"right": rc, "full": F.coalesce(lc, rc)}.get(how, lc)
            out.append(key.alias(name))
        else:
            out.append(left[f"`{name}`"].alias(name + suffix[0]) if name in both else left[f"`{name}`"])
    for c in right_rest:
        if c in both:
            out.append(r2[f"`{c}`"].alias(c + suffix[1]))
        elif c not in left.columns:
            out.append(r2[f"`{c}`"])
    return joined.select(*out)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    """Pass ``df`` through, failing the job if a key value occurs twice.

    Counted with a partial/final aggregate and joined back (null-safe), so the
    check stays distributed; meant for dimension tables joined on a key that
    the data does not declare unique.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    checked = join_on(df, counts, list(keys), how="inner", na_matches="na")
    ok = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"assert_unique: duplicate {what}"))).otherwise(F.lit(True))
    return checked.where(ok).drop("__n")


def on_geography(
    stats: DataFrame,
    geo: DataFrame,
    stats_key: str,
    geo_key: str,
    geo_cols: Sequence[str] | None = None,
    how: str = "right",
    na_matches: str = "na",
) -> DataFrame:
    """Attach statistics to every geography row (J4 ``right_join``, J5 ``left_join``).

    ``how="right"``: columns are the statistics with the key taken from the
    geography (under ``stats_key``), then the other geography columns.
    ``how="left"``: geography first (key under ``geo_key``), then statistics.
    Geography is the preserved side either way, so only the statistics side
    is a broadcast candidate. NULL keys match each other, as in the reference's
    joins, unless ``na_matches="never"``.
    """
    if geo_cols is not None:
        geo = geo.select(geo_key, *[c for c in geo_cols if c != geo_key])
    if how == "right":
        return join_on(stats, geo, {stats_key: geo_key}, "right", na_matches)
    if how == "left":
        return join_on(geo, stats, {geo_key: stats_key}, "left", na_matches)
    raise ValueError("how must be 'right' or 'left'")


def with_group_totals(
    df: DataFrame,
    by: Sequence[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Group aggregates repeated on every row of the group (W2, ``group_by %>% mutate``).

    Aggregated with a partial/final hash aggregate, then joined back on the
    group keys (NULL keys form a group, Q24). Unlike a ``Window.partitionBy``
    this never puts a whole group into one task, so a hot key only makes the
    tiny aggregate side larger, not one partition.
    Columns named in ``totals`` replace same-named columns (Q12).
    """
    agg = df.groupBy(*by).agg(*[e.alias(n) for n, e in totals.items()])
    base = df.drop(*[n for n in totals if n in df.columns])
    return join_on(base, agg, list(by), how="left", na_matches="na")


def append_total(
    detail: DataFrame,
    members: DataFrame,
    by: Sequence[str],
    measures: Sequence[str],
    label_col: str,
    label: str,
    strict: bool = True,
) -> DataFrame:
    """Total rows of ``members`` per ``by`` appended to ``detail``.

    ``members`` may differ from ``detail`` (the reference totals four areas and
    lists five). Union is by name; missing columns are NULL (U1, Q22).
    """
    agg = strict_sum if strict else (lambda c: F.sum(c))
    total = (
        members.groupBy(*by)
        .agg(*[agg(F.col(f"`{m}`")).alias(m) for m in measures])
        .withColumn(label_col, F.lit(label))
    )
    return total.unionByName(detail, allowMissingColumns=True)


def decumulate(
    df: DataFrame,
    cols: dict[str, str],
    order_by: str,
    partition_by: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Daily values from running totals: ``x - lag(x)``.

    ``cols`` maps output name -> cumulative column. With ``partition_by`` the
    lag runs within each group's window. Without, it runs over the order of the
    whole table, range by range (``Ordered``, which checkpoints it). A table
    whose size is bounded, such as one row per date, may ask with ``bounded``
    for the plain window, which is one task and no job ahead.
    """
    if not partition_by and not bounded:
        return differences(df, cols, [order_by])
    w = Window.partitionBy(*partition_by).orderBy(order_by) if partition_by else Window.orderBy(order_by)
    for out, c in cols.items():
        df = df.withColumn(out, F.col(c) - F.lag(c).over(w))
    return df
