"""Building blocks of the queries: filters and totals."""

from fiscal_ledger.operators.filters import LedgerFilter, Where, condition, is_capital, matches_search, outside_overhead
from fiscal_ledger.operators.totals import Sum, exact_sum, key, sum_where, total, totals

__all__ = [
    "LedgerFilter",
    "Sum",
    "Where",
    "condition",
    "exact_sum",
    "is_capital",
    "key",
    "matches_search",
    "outside_overhead",
    "sum_where",
    "total",
    "totals",
]
