"""Spending by unit, funding source and function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.functions.ratios import raw_pct_or_0
from fiscal_ledger.operators.filters import Where, condition
from fiscal_ledger.operators.totals import Sum, key, sum_or_0, totals


def unit_ranking(ledger: DataFrame, where: Where = None, sum_of: Sum = F.sum) -> DataFrame:
    """Budget stages per executing unit with a positive budget, most accrued first."""
    return (
        ledger.where(condition(where))
        .groupBy(key(s.UNIT))
        .agg(*totals(s.PIA, s.PIM, s.CERTIFIED, s.COMMITTED_ANNUAL, s.ACCRUED, sum_of=sum_of))
        .where(F.col("pim") > 0)
        .orderBy(F.desc_nulls_last("accrued"), F.asc_nulls_last("unit"))
    )


def funding_function_distribution(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Budget and accrued by funding source and function."""
    return (
        ledger.where(condition(where))
        .groupBy(key(s.FUNDING), key(s.FUNCTION))
        .agg(*totals(s.PIM, s.ACCRUED))
    )


def _largest(distribution: DataFrame, by: str, limit: int) -> DataFrame:
    """The largest budgets of a distribution rolled up to one column, in ascending order."""
    return (
        distribution.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(sum_or_0("pim"), sum_or_0("accrued"))
        .withColumn("pct", raw_pct_or_0(F.col("accrued"), F.col("pim")))
        .orderBy(F.desc("pim"), by)
        .limit(limit)
        .orderBy("pim", F.desc(by))
    )


def top_funding_sources(ledger: DataFrame, where: Where = None, limit: int = 5) -> DataFrame:
    """The funding sources with the largest budgets."""
    return _largest(funding_function_distribution(ledger, where), "funding_source", limit)


def top_functions(ledger: DataFrame, where: Where = None, limit: int = 5) -> DataFrame:
    """The functions with the largest budgets."""
    return _largest(funding_function_distribution(ledger, where), "function_name", limit)
