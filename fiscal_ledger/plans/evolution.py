"""Spending over the months of the year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.functions.labels import month_name
from fiscal_ledger.functions.ratios import guarded_pct, raw_div, raw_pct
from fiscal_ledger.operators.filters import Where, condition
from fiscal_ledger.operators.totals import key, totals


def monthly_curve(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Certified, committed, accrued and paid by month; rows without a month come last."""
    return (
        ledger.where(condition(where))
        .groupBy(key(s.MONTH))
        .agg(*totals(s.CERTIFIED, s.COMMITTED_ANNUAL, s.ACCRUED, s.PAID))
        .orderBy(F.asc_nulls_last("month"))
    )


def cumulative_evolution(
    ledger: DataFrame, where: Where = None, total_pim: float | None = None
) -> DataFrame:
    """Committed and accrued by month, running, and as a share of the modified budget.

    Without ``total_pim`` the budget of the selection itself is the base,
    summed in the same scan. The windows have no partition, but they run on
    the month totals, one row per month of the year, never on ledger rows.
    """
    months = (
        ledger.where(condition(where))
        .groupBy(key(s.MONTH))
        .agg(*totals(s.COMMITTED_MONTHLY, s.ACCRUED, s.PIM))
    )
    so_far = Window.orderBy(F.asc_nulls_last("month")).rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum("pim").over(Window.partitionBy()) if total_pim is None else F.lit(float(total_pim))

    def running(column: str) -> Column:
        # A month without a number shows what it has and adds nothing to later months.
        known = F.col(column).isNotNull() & ~F.isnan(column)
        return F.when(known, F.sum(F.when(known, F.col(column))).over(so_far)).otherwise(F.col(column))

    return (
        months.withColumns(
            {
                "cumulative_committed": running("committed_monthly"),
                "cumulative_accrued": running("accrued"),
                "base": base,
            }
        )
        .select(
            "month",
            "committed_monthly",
            "accrued",
            "cumulative_committed",
            "cumulative_accrued",
            guarded_pct(F.col("cumulative_committed"), F.col("base")).alias("pct_committed"),
            guarded_pct(F.col("cumulative_accrued"), F.col("base")).alias("pct_accrued"),
            month_name(F.col("month")).alias("month_name"),
        )
        .orderBy(F.asc_nulls_last("month"))
    )


def cumulative_by(
    ledger: DataFrame, by: Sequence[str] = (s.ENTITY,), where: Where = None, months: int = 12
) -> DataFrame:
    """The cumulative evolution of many entities at once: one row per entity and month of the year.

    ``by`` names the columns that make an entity, for example (YEAR, ENTITY). Every entity has all months; one without lines has
    spent nothing and repeats the total so far. A month whose lines have no readable amount shows none and adds
    nothing, and lines without a month come last, as in ``cumulative_evolution``. Shares are of the entity's own budget.

    Lines are summed by entity and month within their tasks, so an entity with very many of them is a few rows when it is shuffled.
    What is missing of the months is added to these sums, not to the lines, and the windows run over at most
    ``months`` + 1 rows each.
    """
    keys = [s.ALIASES[c] for c in by]
    sums = (
        ledger.where(condition(where))
        .groupBy(*[key(c) for c in by], key(s.MONTH))
        .agg(*totals(s.COMMITTED_MONTHLY, s.ACCRUED, s.PIM), F.count(F.lit(1)).alias("lines"))
    )
    spine = sums.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"),
        *[F.lit(None).cast("double").alias(c) for c in ("committed_monthly", "accrued", "pim")],
        F.lit(0).cast("bigint").alias("lines"),
    )
    amounts = ("committed_monthly", "accrued", "pim")
    monthly = sums.unionByName(spine).groupBy(*keys, "month").agg(*[F.sum(c).alias(c) for c in amounts], F.sum("lines").alias("lines"))
    empty = F.col("lines") == 0
    monthly = monthly.withColumns({c: F.when(empty, F.lit(0.0)).otherwise(F.col(c)) for c in amounts[:2]})
    entity = Window.partitionBy(*keys)
    so_far = entity.orderBy(F.asc_nulls_last("month")).rowsBetween(Window.unboundedPreceding, 0)

    def running(column: str) -> Column:
        known = F.col(column).isNotNull() & ~F.isnan(column)
        return F.when(known, F.sum(F.when(known, F.col(column))).over(so_far)).otherwise(F.col(column))

    return (
        monthly.withColumns(
            {
                "cumulative_committed": running("committed_monthly"),
                "cumulative_accrued": running("accrued"),
                "base": F.sum("pim").over(entity),
            }
        )
        .select(
            *keys,
            "month",
            "lines",
            "committed_monthly",
            "accrued",
            "cumulative_committed",
            "cumulative_accrued",
            guarded_pct(F.col("cumulative_committed"), F.col("base")).alias("pct_committed"),
            guarded_pct(F.col("cumulative_accrued"), F.col("base")).alias("pct_accrued"),
            month_name(F.col("month")).alias("month_name"),
        )
        .orderBy(*[F.asc_nulls_last(k) for k in keys], F.asc_nulls_last("month"))
    )


def closing_projection(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Year-end accrued per expense class if the monthly average so far holds.

    Division is unguarded: a class without months or budget shows an infinity or NaN.
    """
    return (
        ledger.where(condition(where))
        .groupBy(key(s.EXPENSE_CLASS_NAME))
        .agg(*totals(s.PIM, s.ACCRUED), F.max(s.MONTH).alias("latest_month"))
        .withColumn("run_rate", raw_div(F.col("accrued"), F.col("latest_month").cast("double")))
        .withColumn("projected", F.col("run_rate") * 12)
        .withColumn("pct_projected", raw_pct(F.col("projected"), F.col("pim")))
    )
