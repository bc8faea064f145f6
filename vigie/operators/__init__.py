"""DataFrame -> DataFrame operators."""

from .aggregates import fixed_window_mean, grouped_sums, peak
from .cells import (
    a1_range, bind_by_row, cell, cell_range, join_block_header, sheet_range, sheets_to_table, strided_blocks,
)
from .columns import mutate, mutate_all, mutate_typed, rename, select_as, select_at
from .ordered import Ordered, differences, with_row_number
from .panel import (
    append_total, assert_unique, decumulate, join_on, keep_present, latest, max_of, on_geography, trailing_days,
    with_comparator, with_group_totals,
)
from .reshape import pivot_map, pivot_wide, transpose, unnest, unpivot_long, unpivot_map

__all__ = [
    "Ordered", "differences", "pivot_map", "unpivot_map", "with_row_number",
    "fixed_window_mean", "grouped_sums", "peak",
    "a1_range", "bind_by_row", "cell", "cell_range", "join_block_header", "sheet_range", "sheets_to_table",
    "strided_blocks",
    "mutate", "mutate_all", "mutate_typed", "rename", "select_as", "select_at",
    "append_total", "assert_unique", "decumulate", "join_on", "keep_present", "latest", "max_of", "on_geography",
    "trailing_days", "with_comparator", "with_group_totals",
    "pivot_wide", "transpose", "unnest", "unpivot_long",
]
