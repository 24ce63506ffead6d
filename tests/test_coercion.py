"""Text-to-number coercion, cell by cell and against DuckDB's TRY_CAST on generated texts."""

from __future__ import annotations

import math
import re

import duckdb
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscal_ledger.functions import text_to_double, text_to_int, to_double, to_int

INTEGERS = {
    "6": 6,
    " 6 ": 6,
    "06": 6,
    "6.0": 6,
    "6.5": 7,
    "-6.5": -7,
    "6.4": 6,
    "1e1": 10,
    "1_0": 10,
    "x": None,
    "": None,
    "S/M": None,
    "NaN": None,
    "inf": None,
    "1e20": None,
    "2147483647": 2147483647,
    "2147483648": None,
    None: None,
}
DOUBLES = {
    "1,234.50": None,
    " 12.5 ": 12.5,
    "": None,
    "abc": None,
    "N/D": None,
    "1e3": 1000.0,
    "1_000": 1000.0,
    "1__000": None,
    "_1": None,
    "1_": None,
    "1_0.5": 10.5,
    "1.5d": None,
    "1.5f": None,
    "1.5F ": None,
    "1D\t": None,
    "0x1p3": None,
    "inf": math.inf,
    "-inf": -math.inf,
    "Infinity": math.inf,
    "-5": -5.0,
    "+5": 5.0,
    ".5": 0.5,
    "5.": 5.0,
    None: None,
}


def _convert(spark, function, values, source="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {source}")
    rows = frame.select("i", function(F.col("v")).alias("r")).collect()
    return [row.r for row in sorted(rows)]


def test_integers(spark):
    assert _convert(spark, text_to_int, INTEGERS) == list(INTEGERS.values())


def test_doubles(spark):
    assert _convert(spark, text_to_double, DOUBLES) == list(DOUBLES.values())
    assert all(math.isnan(v) for v in _convert(spark, text_to_double, ["NaN", "nan"]))


def test_numbers_that_are_not_text(spark):
    def as_int(source):
        return lambda column: to_int(column, source)

    assert _convert(spark, as_int(T.DoubleType()), [6.5, 7.5, -0.4, None, 1e20], "double") == [6, 8, 0, None, None]
    assert _convert(spark, as_int(T.LongType()), [6, 2**40], "bigint") == [6, None]
    assert _convert(spark, lambda c: to_int(c.cast("decimal(5,2)"), T.DecimalType(5, 2)), [6.5], "double") == [7]
    assert _convert(spark, lambda c: to_double(c, T.IntegerType()), [6, None], "int") == [6.0, None]


# Digits, signs, separators and letters that numbers use. Left out are forms that DuckDB reads as
# integers and no ledger relies on: radix prefixes (0x10, 0b11), doubled signs and a point after an exponent.
number_like = st.from_regex(r"\A ?[+-]?[0-9]{0,4}(_?[0-9]{1,3})?([.][0-9_]{0,3})?([eE][+-]?[0-9]{1,2})?[dDfF]? ?\Z")
junk = st.text(alphabet="0123456789.,_eEfFdD -/NSMaif", max_size=8).filter(lambda t: not re.search(r"[eE]-?[0-9_]+[.]", t))


def same(left, right):
    """Equal values; NaN equals itself and the two zeros are one."""
    return left == right or (left != left and right != right)


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(st.lists(number_like | junk, min_size=200, max_size=400, unique=True))
def test_agrees_with_try_cast(spark, duck, texts):
    expected = duck.execute(
        "SELECT TRY_CAST(t AS DOUBLE), TRY_CAST(t AS INTEGER) FROM (SELECT unnest(?) AS t)", [texts]
    ).fetchall()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = sorted(frame.select("i", text_to_double(F.col("t")).alias("d"), text_to_int(F.col("t")).alias("n")).collect())
    different = [
        (text, (row.d, row.n), pair)
        for text, row, pair in zip(texts, rows, expected, strict=True)
        if not same(row.d, pair[0]) or row.n != pair[1]
    ]
    assert different == []
