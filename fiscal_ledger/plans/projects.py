"""Capital projects: progress, search, risk, sheet and history.

"Project" is (CUI, name) for progress and risk ranking, the name alone for
spill-over alerts and the CUI alone for the sheet and its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.functions.ratios import guarded_pct, nullif_pct, raw_pct_or_0
from fiscal_ledger.operators.filters import Where, condition, is_capital, matches_search
from fiscal_ledger.operators.totals import Sum, key, sum_or_0, totals

_STAGES = (s.PIA, s.PIM, s.CERTIFIED, s.COMMITTED_ANNUAL, s.ACCRUED)


def _capital_rows(ledger: DataFrame, where: Where) -> DataFrame:
    return ledger.where(condition(where)).where(is_capital())


def _progress(ledger: DataFrame, where: Where, sum_of: Sum = F.sum) -> DataFrame:
    return (
        _capital_rows(ledger, where)
        .groupBy(key(s.CUI), key(s.PROJECT))
        .agg(*totals(*_STAGES, sum_of=sum_of))
        .where(F.col("pim") > 0)
        .withColumn("pct", raw_pct_or_0(F.col("accrued"), F.col("pim")))
        .withColumn("overrun", F.col("pim") - F.col("pia"))
    )


def _most_accrued_first(progress: DataFrame) -> DataFrame:
    # The CUI and name also spread the many projects with equal amounts over the sort's ranges.
    return progress.orderBy(
        F.desc_nulls_last("accrued"), F.asc_nulls_last("cui"), F.asc_nulls_last("project")
    )


def project_progress(ledger: DataFrame, where: Where = None, sum_of: Sum = F.sum) -> DataFrame:
    """Budget stages, progress and overrun per capital project, most accrued first."""
    return _most_accrued_first(_progress(ledger, where, sum_of))


def project_totals(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Number of projects, their budget and their overrun; amounts that are no numbers count as 0."""
    return _progress(ledger, where).agg(
        F.count("*").alias("projects"),
        sum_or_0("pim"),
        sum_or_0("overrun"),
    )


def project_search(ledger: DataFrame, text: str | None, where: Where = None) -> DataFrame:
    """Project progress narrowed by a search on name or CUI."""
    found = _progress(ledger, where).where(matches_search(text, F.col("project"), F.col("cui")))
    return _most_accrued_first(found)


def risk_ranking(ledger: DataFrame, where: Where = None, limit: int = 50, unit_names: DataFrame | None = None) -> DataFrame:
    """The capital projects with the lowest progress, each with the last of its units in text order.

    Spark sorts the input of a MAX of text. With ``unit_names``, a dictionary from ``write_names``, the lines carry the
    units' numbers instead, whose maximum stays in the hash-aggregation buffer, and only the
    projects that are left at the end are given their unit's name. A unit that the dictionary lacks is an error.
    """
    rows = _capital_rows(ledger, where)
    if unit_names is None:
        last_unit = F.max(s.UNIT).alias("unit")
    else:
        numbers = unit_names.select(F.col("name").alias(s.UNIT), F.col("number").alias("unit_number"))
        rows = rows.join(numbers, s.UNIT, "left")
        unknown = F.col(s.UNIT).isNotNull() & F.col("unit_number").isNull()
        error = F.raise_error(F.concat(F.lit("not in the dictionary of units: "), F.col(s.UNIT))).cast("bigint")
        last_unit = F.max(F.when(unknown, error).otherwise(F.col("unit_number"))).alias("unit")
    order = F.asc_nulls_last("pct"), F.asc_nulls_last("cui"), F.asc_nulls_last("project")
    lowest = (
        rows.groupBy(key(s.CUI), key(s.PROJECT))
        .agg(last_unit, *totals(s.PIM, s.ACCRUED))
        .where(F.col("pim") > 0)
        .withColumn("pct", nullif_pct(F.col("accrued"), F.col("pim")))
        .orderBy(*order)
        .limit(limit)
    )
    if unit_names is None:
        return lowest
    named = lowest.withColumnRenamed("unit", "number").join(unit_names, "number", "left")
    return named.select("cui", "project", F.col("name").alias("unit"), "pim", "accrued", "pct").orderBy(*order)


def project_sheet(
    ledger: DataFrame,
    cui: str,
    where: Where = None,
    low_below: float = 30.0,
    critical_below: float = 15.0,
) -> DataFrame:
    """One capital project in a row, or no row if there is none.

    All rows have the same CUI, so they are summed without a key: a MAX of
    text per key would sort them first, and one project may hold many rows.
    """
    pct = F.col("pct")
    return (
        _capital_rows(ledger, where)
        .where(F.col(s.CUI) == F.lit(cui))
        .agg(
            F.count("*").alias("lines"),
            *[F.max(c).alias(s.ALIASES[c]) for c in (s.PROJECT, s.UNIT, s.FUNCTION)],
            *totals(*_STAGES),
        )
        .where(F.col("lines") > 0)
        .withColumn("pct", guarded_pct(F.col("accrued"), F.col("pim")))
        .select(
            F.lit(cui).alias("cui"),
            *[s.ALIASES[c] for c in (s.PROJECT, s.UNIT, s.FUNCTION, *_STAGES)],
            "pct",
            F.coalesce(pct < low_below, F.lit(False)).alias("low"),
            F.coalesce((F.col("pim") > 0) & (pct < critical_below), F.lit(False)).alias("critical"),
        )
    )


def project_history(ledger: DataFrame, cui: str, where: Where = None) -> DataFrame:
    """One capital project by fiscal year."""
    return (
        _capital_rows(ledger, where)
        .where(F.col(s.CUI) == F.lit(cui))
        .groupBy(key(s.YEAR))
        .agg(*totals(*_STAGES))
        .withColumn("pct", raw_pct_or_0(F.col("accrued"), F.col("pim")))
        .orderBy(F.asc_nulls_last("fiscal_year"))
    )


def _spillover_risk(certified: Column, committed: Column, pim: Column) -> Column:
    """Risk of returning the budget: nothing certified, little committed, or neither.

    A missing amount fails its test and falls through to the next.
    """
    return (
        F.when(certified == 0, "extreme").when(nullif_pct(committed, pim) < 40, "medium").otherwise("safe")
    )


def spillover_alerts(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Capital projects by name with the risk that their budget lapses at year end."""
    return (
        _capital_rows(ledger, where)
        .groupBy(key(s.PROJECT))
        .agg(
            *totals(s.PIM, s.CERTIFIED, s.COMMITTED_ANNUAL, s.ACCRUED),
            F.max(s.MONTH).alias("latest_month"),
        )
        .where(F.col("pim") > 0)
        .withColumn("risk", _spillover_risk(F.col("certified"), F.col("committed_annual"), F.col("pim")))
    )
