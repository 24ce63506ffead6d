"""The ratio rules of the ledger queries.

They differ only in what a zero, missing or negative denominator gives, and
those differences show up in the reports, so each has its own helper:

=================  =============  ========  =========  =======  ==================
helper             den = 0        den NULL  den < 0    den NaN  num NULL, den > 0
=================  =============  ========  =========  =======  ==================
``guarded_pct``    0              0         0          0        NULL
``nullif_pct``     NULL           NULL      computed   NaN      NULL
``raw_pct``        inf/-inf/NaN   NULL      computed   NaN      NULL
``raw_pct_or_0``   inf/-inf/0     0         computed   0        0
=================  =============  ========  =========  =======  ==================

Spark orders NaN above all numbers, so a guard must rule it out.

``try_divide`` gives the same quotient as ``/`` and does not depend on the
session's ANSI setting when the denominator is zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")
_NAN = float("nan")


def guarded_pct(num: Column, den: Column) -> Column:
    return F.when((den > 0) & ~F.isnan(den), F.try_divide(num, den) * 100).otherwise(F.lit(0.0))


def nullif_pct(num: Column, den: Column) -> Column:
    return F.try_divide(num, den) * 100


def raw_div(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN."""
    by_zero = (
        F.when(F.isnan(num) | (num == 0), F.lit(_NAN)).when(num > 0, F.lit(_INF)).when(num < 0, F.lit(-_INF))
    )
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def raw_pct(num: Column, den: Column) -> Column:
    return raw_div(num, den) * 100


def raw_pct_or_0(num: Column, den: Column) -> Column:
    return F.coalesce(F.nanvl(raw_pct(num, den), F.lit(0.0)), F.lit(0.0))
