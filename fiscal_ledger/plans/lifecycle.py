"""Projects over all fiscal years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.operators.filters import Where, condition
from fiscal_ledger.operators.totals import key, totals


def _year_of(amount: str) -> Column:
    """The year as an ordering key that skips years without the amount."""
    return F.when(F.col(amount).isNotNull(), F.col("fiscal_year"))


def lifecycle_audit(ledger: DataFrame, where: Where = None) -> DataFrame:
    """First and last year of each CUI, its total accrued, first opening and last modified budget.

    Pass a filter without a year (``LedgerFilter.without_year``); a year would
    cut the lives short. All expense classes count, the catch-all code does not.

    Spark sorts the input of a MAX of text, so the ledger rows are first
    hash-aggregated with the name among the keys. Names hardly vary within a
    project, and the two text maxima then run on the few rows that are left. That first
    aggregation reduces its rows within the task before its shuffle,
    which is what keeps a project holding a large share of the rows harmless.
    What is left of a project is one row per year and name, so all of it
    can go to one task, and the two levels above share that shuffle.
    """
    named = (
        ledger.where(condition(where))
        .where(F.col(s.CUI) != s.CATCH_ALL_CUI)
        .groupBy(key(s.CUI), key(s.YEAR), key(s.PROJECT))
        .agg(*totals(s.PIA, s.PIM, s.ACCRUED))
        .repartition("cui")
    )
    yearly = named.groupBy("cui", "fiscal_year").agg(
        F.max("project").alias("project"), *[F.sum(c).alias(c) for c in ("pia", "pim", "accrued")]
    )
    return (
        yearly.groupBy("cui")
        .agg(
            F.max("project").alias("project"),
            F.min("fiscal_year").alias("first_year"),
            F.max("fiscal_year").alias("last_year"),
            F.sum("accrued").alias("total_accrued"),
            F.min_by("pia", _year_of("pia")).alias("opening_pia"),
            F.max_by("pim", _year_of("pim")).alias("closing_pim"),
        )
        .orderBy(F.desc_nulls_last("closing_pim"), "cui")
    )
