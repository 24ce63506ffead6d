"""The truth table of the ratio helpers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fiscal_ledger.functions import guarded_pct, nullif_pct, raw_div, raw_pct, raw_pct_or_0

INF, NAN = math.inf, math.nan
PAIRS = [(1.0, 4.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (1.0, None), (1.0, -4.0), (None, 4.0), (None, 0.0), (NAN, 0.0), (1.0, NAN)]
EXPECTED = {
    guarded_pct: [25.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0],
    nullif_pct: [25.0, None, None, None, None, -25.0, None, None, None, NAN],
    raw_div: [0.25, INF, -INF, NAN, None, -0.25, None, None, NAN, NAN],
    raw_pct: [25.0, INF, -INF, NAN, None, -25.0, None, None, NAN, NAN],
    raw_pct_or_0: [25.0, INF, -INF, 0.0, 0.0, -25.0, 0.0, 0.0, 0.0, 0.0],
}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("helper", EXPECTED, ids=lambda h: h.__name__)
def test_truth_table(spark, helper, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        frame = spark.createDataFrame([(i, *pair) for i, pair in enumerate(PAIRS)], "i int, num double, den double")
        rows = frame.select("i", helper(F.col("num"), F.col("den")).alias("r")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert [repr(row.r) for row in sorted(rows)] == [repr(v) for v in EXPECTED[helper]]
