"""Long <-> wide reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot_wide(
    df: DataFrame,
    id_cols: Sequence[str],
    names_from: str,
    values_from: str,
    names: Sequence | None,
    aliases: Sequence[str] | None = None,
) -> DataFrame:
    """``pivot_wider``.

    A cell that would receive two rows raises an error instead of silently
    keeping one (Q19). Pass the new columns in ``names`` so that the output
    schema is stable and no extra job runs; ``names=None`` lets Spark list the
    distinct values first (one more job, at most ``spark.sql.pivotMaxValues``
    labels, which is meant for label columns such as region names). A label that
    ``names`` does not list raises. Rows whose ``names_from`` is NULL have no
    column to go to; they only keep their ``id_cols`` in the result.
    """
    if names is not None:
        label = F.col(f"`{names_from}`")
        refuse = F.raise_error(F.concat(F.lit("pivot_wide: label not listed: "), label.cast("string")))
        df = df.withColumn(names_from, F.when(label.isNull() | label.isin(list(names)), label)
                           .otherwise(refuse.cast(df.schema[names_from].dataType)))
    grouped = df.groupBy(*id_cols)
    pivoted = grouped.pivot(names_from) if names is None else grouped.pivot(names_from, list(names))
    cells = pivoted.agg(
        F.when(
            F.count(F.lit(1)) > 1,
            F.raise_error(F.lit(f"pivot_wide: several values for one cell of {values_from}")),
        ).otherwise(F.max(values_from))
    )
    if aliases is not None and names is not None:
        cells = cells.withColumnsRenamed({str(n): a for n, a in zip(names, aliases)})
    return cells


def pivot_map(df: DataFrame, id_cols: Sequence[str], names_from: str, values_from: str, out: str = "cells") -> DataFrame:
    """``pivot_wider`` over whatever labels the data hold, any number of them.

    One row per id with its cells as a map from label to value, in the labels'
    order; the labels are found in the same pass, so neither a list nor
    ``spark.sql.pivotMaxValues`` bounds them, and the schema stays the same. A
    cell that would receive two rows raises (Q19). A NULL label has no cell.
    """
    label = F.col(f"`{names_from}`").alias("label")
    cells = F.sort_array(F.collect_list(F.when(F.col(f"`{names_from}`").isNotNull(), F.struct(label, F.col(f"`{values_from}`").alias("value")))))
    rows = df.groupBy(*id_cols).agg(cells.alias(out))
    labels = F.col(f"`{out}`.label")
    twice = F.raise_error(F.lit(f"pivot_map: several values for one cell of {values_from}"))
    sound = F.when(F.size(F.array_distinct(labels)) == F.size(labels), F.map_from_entries(F.col(f"`{out}`")))
    return rows.withColumn(out, sound.otherwise(twice.cast(T.MapType(df.schema[names_from].dataType, df.schema[values_from].dataType))))


def unpivot_map(df: DataFrame, cells: str = "cells", names_to: str = "name", values_to: str = "value") -> DataFrame:
    """``pivot_map`` back to one row per cell; an id without cells has no row."""
    others = [F.col(f"`{c}`") for c in df.columns if c != cells]
    return df.select(*others, F.explode(F.col(f"`{cells}`")).alias(names_to, values_to))


def unpivot_long(
    df: DataFrame,
    id_cols: Sequence[str],
    value_cols: Sequence[str] | None = None,
    names_to: str = "name",
    values_to: str = "value",
) -> DataFrame:
    """``pivot_longer(-id)`` (R2): one row per (id, column); NULL cells are kept."""
    if value_cols is None:
        value_cols = [c for c in df.columns if c not in id_cols]
    return df.unpivot(list(id_cols), list(value_cols), names_to, values_to)


def transpose(
    df: DataFrame,
    id_col: str,
    new_id: str,
    names: Sequence,
) -> DataFrame:
    """Rows become columns and columns rows (R3 = R2 then R1).

    ``names`` are the values of ``id_col`` that become the new columns;
    the old column names become the values of ``new_id``.
    """
    long = unpivot_long(df, [id_col], names_to=new_id, values_to="__v")
    return pivot_wide(long, [new_id], id_col, "__v", names)


def unnest(df: DataFrame, list_col: str) -> DataFrame:
    """List-column of structs -> rows and columns (R5, ``unnest``)."""
    others = [c for c in df.columns if c != list_col]
    return df.select(*others, F.inline(list_col))
