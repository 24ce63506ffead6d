"""Sums that do not depend on how the rows are dealt out."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from checks import ledgers
from fiscal_ledger import plans
from fiscal_ledger.operators import exact_sum
from tests.conftest import SF_DIR
from tests.micro import rows


def bits(value):
    return None if value is None else struct.pack(">d", value)


def of(spark, values, partitions=3):
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)
    return frame.agg(exact_sum(F.col("x"))).first()[0]


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_bit_equal_over_partitions(spark, partitions):
    ledger = ledgers.fraction_ledger(spark, SF_DIR)
    expected = [[bits(v) for v in r] for r in rows(plans.kpi_summary(ledger, sum_of=exact_sum))]
    dealt = ledger.withColumn("by", F.rand(partitions)).repartition(partitions, "by")
    assert [[bits(v) for v in r] for r in rows(plans.kpi_summary(dealt, sum_of=exact_sum))] == expected
    per_unit = {r.unit: bits(r.pim) for r in plans.unit_ranking(ledger, sum_of=exact_sum).collect()}
    assert {r.unit: bits(r.pim) for r in plans.unit_ranking(dealt, sum_of=exact_sum).collect()} == per_unit
    board = plans.kpi_board(ledger, sum_of=exact_sum).first()
    assert [bits(v) for v in plans.kpi_board(dealt, sum_of=exact_sum).first()] == [bits(v) for v in board]


def test_plain_sums_are_not(spark):
    """What the exact sums are for: the plain ones change with the order."""
    values = [1e16, 1.0, -1e16, 0.1] * 500
    shuffled = random.Random(1).sample(values, len(values))
    plain = {spark.createDataFrame([(v,) for v in vs], "x double").coalesce(1).agg(F.sum("x")).first()[0] for vs in (values, shuffled)}
    assert len(plain) == 2
    assert of(spark, values) == of(spark, shuffled, 7) == math.fsum(values)


def test_the_sum_is_the_real_one(spark):
    rng = random.Random(5)
    for scale in (1e-4, 1.0, 1e9, 1e15, 1e20):
        values = [rng.uniform(-1, 1) * scale for _ in range(400)]
        found, real = of(spark, values), sum(map(Fraction, values))
        # Digits are added highest first, so the last bit may be off by one.
        assert abs(Fraction(found) - real) <= Fraction(math.ulp(float(real))) + 400 * Fraction(1, 2**78)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([], None),
        ([None], None),
        ([None, 0.1, 0.2], math.fsum([0.1, 0.2])),
        ([-0.1] * 10, -1.0),
        ([0.0, -0.0], 0.0),
        ([1.0, math.inf], math.inf),
        ([1.0, math.inf, -math.inf], math.nan),
        ([1.0, math.nan], math.nan),
        ([1e300, 1.0], 1e300),
        ([2.0**60, 1.0, -(2.0**60)], 1.0),
        ([5e-324, -5e-324], 0.0),
        ([3.0, 4.0], 7.0),
    ],
)
def test_edges(spark, values, expected):
    found = of(spark, values)
    assert found == expected or (math.isnan(found) and math.isnan(expected))


def test_by_key_with_hot_key(spark):
    frame = spark.range(30_000).select((F.col("id") % 3 == 0).alias("hot"), (F.col("id") / 7.0).alias("x"))
    keyed = frame.withColumn("k", F.when(F.col("hot"), -1).otherwise(F.floor("x") % 50))
    found = {r.k: r.x for r in keyed.groupBy("k").agg(exact_sum(F.col("x")).alias("x")).collect()}
    plain = {}
    for r in keyed.collect():
        plain.setdefault(r.k, []).append(r.x)
    assert all(abs(found[k] - math.fsum(v)) <= math.ulp(math.fsum(v)) for k, v in plain.items())
