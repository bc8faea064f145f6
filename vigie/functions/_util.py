from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    """A Column is used as is, anything else becomes a literal."""
    return v if isinstance(v, Column) else F.lit(v)
