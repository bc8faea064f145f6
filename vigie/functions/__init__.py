"""Column -> Column functions with the reference's semantics."""

from .classes import TRAFFIC_LIGHT, classify, relabel
from .dates import (
    MONTHS_FR,
    MONTHS_FR_SHORT,
    as_of_or_now,
    date_minus,
    day_month,
    day_month_year,
    month_label,
    month_name,
    parse_date,
    parse_day_month,
    stamp,
)
from .missing import fill, missing, na_sum, pct_change, present, r_divide, safe_ratio, strict_sum
from .numbers import finite, number_text, round_even, to_text, with_number_texts
from .text import encode_repair, join_text, pad_left, recode, sentence, substring_between

__all__ = [
    "TRAFFIC_LIGHT", "classify", "relabel",
    "MONTHS_FR", "MONTHS_FR_SHORT", "as_of_or_now", "date_minus", "day_month",
    "day_month_year", "month_label", "month_name", "parse_date", "parse_day_month", "stamp",
    "fill", "missing", "na_sum", "pct_change", "present", "r_divide", "safe_ratio", "strict_sum",
    "finite", "number_text", "round_even", "to_text", "with_number_texts",
    "encode_repair", "join_text", "pad_left", "recode", "sentence", "substring_between",
]
