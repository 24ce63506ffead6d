"""Sums of the ledger measures, plain and per key.

A plain sum of doubles depends on the order in which tasks add them up, in its last bits and only where amounts have
fractions. ``exact_sum`` does not: it can take the place of ``F.sum`` wherever a query has a ``sum_of``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscal_ledger import schema as s


def key(column: str) -> Column:
    """A ledger column under its result name."""
    return F.col(column).alias(s.ALIASES[column])


Sum = Callable[[Column], Column]

# Bits of a limb, and the least power of two that an exact sum tells apart.
LIMB_BITS = 26
LOWEST_BITS = 3 * LIMB_BITS
# Of amounts beyond only the highest limb counts.
LARGEST = 2.0**79


def exact_sum(value: Column) -> Column:
    """SUM of doubles that is the same bit for bit however the rows are dealt out and whichever tasks run again.

    An amount is cut into whole numbers, limbs of 26 bits that stand for multiples of 2^26, 1, 2^-26, 2^-52 and 2^-78: each is what
    rounding to its multiple leaves over from rounding to the one above, and these differences of doubles are exact. The lower limbs are
    added up as bigints, the highest, which also carries infinities and NaN, as a double of whole numbers below 2^53; both are exact in any
    order. Only the five totals become a double again, highest first, after their carries. So the result is
    that of the real sum, but for what an amount has below 2^-78. The limbs' sums hold 2^37 rows a key, and
    absolute amounts of 2^79 in all. NULL without any amount.
    """
    kept = F.when(F.abs(value) < LARGEST, value).otherwise(F.lit(0.0))

    def rounded(bits: int) -> Column:
        return F.rint(kept * 2.0**bits)

    # Carries, lowest limb first: what a limb keeps is from 0 up to 2^26.
    carry, digits = None, []
    for bits in range(LOWEST_BITS, -1, -LIMB_BITS):
        limb = F.sum((rounded(bits) - rounded(bits - LIMB_BITS) * 2.0**LIMB_BITS).cast("bigint"))
        limb = limb if carry is None else limb + carry
        digits.append(limb.bitwiseAND(F.lit((1 << LIMB_BITS) - 1)))
        carry = F.shiftright(limb, LIMB_BITS)
    # Two digits make 52 bits, which a double holds.
    low, high = ((F.shiftleft(upper, LIMB_BITS) + lower).cast("double") for lower, upper in (digits[:2], digits[2:]))
    top = (F.sum(F.rint(value * 2.0**-LIMB_BITS)) + carry.cast("double")) * 2.0**LIMB_BITS
    return top + high * 2.0**-LIMB_BITS + low * 2.0**-LOWEST_BITS


def total(measure: str, sum_of: Sum = F.sum) -> Column:
    """SUM of a measure under its result name."""
    return sum_of(F.col(measure)).alias(s.ALIASES[measure])


def totals(*measures: str, sum_of: Sum = F.sum) -> list[Column]:
    return [total(m, sum_of) for m in measures]


def sum_or_0(column: str) -> Column:
    """SUM that counts NULL and NaN as 0."""
    return F.coalesce(F.sum(F.when(~F.isnan(column), F.col(column))), F.lit(0.0)).alias(column)


def sum_where(test: Column, measure: str, sum_of: Sum = F.sum) -> Column:
    """SUM of a measure over the rows that pass a test, 0 for the others."""
    return sum_of(F.when(test, F.col(measure)).otherwise(F.lit(0.0)))
