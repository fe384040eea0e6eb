"""Column expressions (all built-in Spark functions, whole-stage-codegen friendly)."""

from .dates import (as_of_col, day_key, epoch_micros, in_range, month_key, parse_timestamp,
                    to_timestamp_col)
from .display import inr_display, number_text
from .numbers import finite_or_null, is_finite, parse_amount, round_half_up, to_amount
from .text import intent_flags, intent_primary, js_trim, strip_markup

__all__ = [
    "as_of_col", "day_key", "epoch_micros", "in_range", "month_key", "parse_timestamp",
    "to_timestamp_col", "inr_display", "number_text", "finite_or_null", "is_finite",
    "parse_amount", "round_half_up", "to_amount", "intent_flags", "intent_primary", "js_trim",
    "strip_markup",
]
