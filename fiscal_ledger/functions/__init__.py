"""Column expressions shared by the queries."""

from fiscal_ledger.functions.coercion import text_to_double, text_to_int, to_double, to_int
from fiscal_ledger.functions.labels import code_name_label, label_code, month_name
from fiscal_ledger.functions.ratios import guarded_pct, nullif_pct, raw_div, raw_pct, raw_pct_or_0

__all__ = [
    "code_name_label",
    "guarded_pct",
    "label_code",
    "month_name",
    "nullif_pct",
    "raw_div",
    "raw_pct",
    "raw_pct_or_0",
    "text_to_double",
    "text_to_int",
    "to_double",
    "to_int",
]
