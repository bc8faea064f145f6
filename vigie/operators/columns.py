"""Projections: by position (P3), by type (P8), over all columns (P9), renames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def select_at(df: DataFrame, *positions: int) -> DataFrame:
    """Select columns by 1-based position, resolved to names at plan time."""
    names = df.columns
    outside = [i for i in positions if not 1 <= i <= len(names)]
    if outside:
        raise ValueError(f"select_at: positions {outside} are not among 1..{len(names)}")
    return df.select(*[F.col(f"`{names[i - 1]}`") for i in positions])


def select_as(df: DataFrame, mapping: Mapping[str, str] | Sequence) -> DataFrame:
    """``select(new = old, ...)``: ``mapping`` is ``{new: old}`` or a list of names / (new, old)."""
    items = mapping.items() if isinstance(mapping, Mapping) else [
        (m, m) if isinstance(m, str) else m for m in mapping
    ]
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in items])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``rename(new = old)`` with ``mapping`` as ``{new: old}``."""
    return df.withColumnsRenamed({old: new for new, old in mapping.items()})


def mutate_typed(
    df: DataFrame,
    types: tuple,
    fn: Callable[[Column], Column],
) -> DataFrame:
    """Apply ``fn`` to every column whose type is one of ``types`` (``mutate_if``)."""
    return df.select(*[
        fn(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, types) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def mutate_all(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column (``mutate_all``)."""
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) for c in df.columns])


def mutate(df: DataFrame, **exprs: Column) -> DataFrame:
    """Sequential derive: each expression sees the columns made before it (Q12)."""
    for name, e in exprs.items():
        df = df.withColumn(name, e)
    return df
