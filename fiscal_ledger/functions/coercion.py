"""Lenient text-to-number conversion: what cannot be read becomes NULL, never an error.

Everything is a built-in column expression. A ledger converts nine columns
in one projection, so each expression is kept short: the JVM does not compile
a generated method beyond 8000 bytes of code, and interpreting it is several
times slower than a regular expression per value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What makes a text no number although Spark's cast, without the underscores, would take it:
# a Java type suffix (1.5f, 2d), a hex float (0x1p3), or an underscore that is not between digits.
# The lookahead lets the search pass over ordinary characters with a single test.
_NOT_A_NUMBER = r"(?=[dDfFpP_])([pP]|(?<=[0-9.])[dDfF]\s*$|(?<![0-9])_|_(?![0-9]))"


def text_to_double(text: Column) -> Column:
    """Read a text as a double. Digits may be separated by underscores (1_000).

    Whole numbers, the bulk of a ledger, are read as bigint first: that parses
    the bytes in place, where the cast to double makes a string of each value.
    """
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.coalesce(
        text.try_cast("bigint").cast("double"),
        F.when(~text.rlike(_NOT_A_NUMBER), digits).try_cast("double"),
    )


def text_to_int(text: Column) -> Column:
    """Read a text as an int; a fraction or exponent rounds half away from zero."""
    return F.coalesce(text.try_cast("int"), F.round(text_to_double(text)).try_cast("int"))


def to_double(column: Column, source: T.DataType) -> Column:
    """Coerce a column of type ``source`` to double."""
    if isinstance(source, T.StringType):
        return text_to_double(column)
    return column.try_cast("double")


def to_int(column: Column, source: T.DataType) -> Column:
    """Coerce a column of type ``source`` to int: floats round half to even, decimals half up."""
    if isinstance(source, T.StringType):
        return text_to_int(column)
    if isinstance(source, (T.DoubleType, T.FloatType)):
        return F.rint(column).try_cast("int")
    if isinstance(source, T.DecimalType):
        return F.round(column, 0).try_cast("int")
    return column.try_cast("int")
