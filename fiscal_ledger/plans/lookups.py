"""Value lists for choosing filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.functions.labels import code_name_label
from fiscal_ledger.operators.filters import LedgerFilter, Where, condition, is_capital


def _sorted_distinct(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.select(value.alias(name)).distinct().orderBy(F.col(name).asc_nulls_last())


def filter_options(ledger: DataFrame, column: str, where: Where = None) -> DataFrame:
    """Distinct non-null values of any ledger column, ascending."""
    rows = ledger.where(condition(where)).where(F.col(column).isNotNull())
    return _sorted_distinct(rows, F.col(column), "option")


# The selectors in the order they are chosen: each offers what the choices before it leave.
SELECTORS = ("year", "level", "sector", "entity", "unit")


def cascade_options(ledger: DataFrame, where: LedgerFilter | None = None) -> DataFrame:
    """The options of all five selectors for the choices made so far: (position, selector, option).

    Each list is what its own query gives (``years_available``, ``filter_options`` of a level under the
    choices above it, ``executing_units``), but the ledger is read once for all of them. It is first reduced to the distinct paths
    through the hierarchy, by partial aggregation before the shuffle; those few rows are
    then turned into options, one per list that their path belongs to. Years come latest first, the others ascending.
    """
    chosen = where or LedgerFilter()
    paths = ledger.select(s.YEAR, s.LEVEL, s.SECTOR, s.ENTITY, s.UNIT_CODE, s.UNIT).distinct()
    values = {
        "year": F.col(s.YEAR).cast("int").cast("string"),
        "level": F.col(s.LEVEL),
        "sector": F.col(s.SECTOR),
        "entity": F.col(s.ENTITY),
        "unit": code_name_label(F.col(s.UNIT_CODE), F.col(s.UNIT)),
    }
    above = LedgerFilter()
    options = []
    for position, selector in enumerate(SELECTORS, 1):
        value = F.when(above.to_column(), values[selector])
        options.append(F.struct(F.lit(position).alias("position"), F.lit(selector).alias("selector"), value.alias("option")))
        above = replace(above, **{selector: getattr(chosen, selector)})
    listed = paths.select(F.explode(F.array(*options)).alias("o")).select("o.*").where(F.col("option").isNotNull()).distinct()
    newest = F.when(F.col("position") == 1, F.col("option").cast("int"))
    return listed.orderBy("position", newest.desc_nulls_last(), "option")


def years_available(ledger: DataFrame) -> DataFrame:
    """Distinct fiscal years, latest first."""
    return (
        ledger.where(F.col(s.YEAR).isNotNull())
        .select(F.col(s.YEAR).cast("int").alias("fiscal_year"))
        .distinct()
        .orderBy(F.desc("fiscal_year"))
    )


def executing_units(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Labels ``code - unit``."""
    return _sorted_distinct(
        ledger.where(condition(where)), code_name_label(F.col(s.UNIT_CODE), F.col(s.UNIT)), "unit_label"
    )


def budget_goals(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Labels ``code - goal``."""
    return _sorted_distinct(
        ledger.where(condition(where)), code_name_label(F.col(s.GOAL_CODE), F.col(s.GOAL)), "goal_label"
    )


def project_list(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Labels ``CUI - project`` of the capital projects."""
    return _sorted_distinct(
        ledger.where(condition(where)).where(is_capital()),
        code_name_label(F.col(s.CUI), F.col(s.PROJECT)),
        "project_label",
    )


def project_lookup(ledger: DataFrame, where: Where = None) -> DataFrame:
    """One label per CUI of the capital projects; a renamed project shows its last label in text order.

    Spark sorts the input of a MAX of text by key, so the ledger rows are
    hash-aggregated to distinct labels first and only those are sorted.
    """
    label = code_name_label(F.col(s.CUI), F.col(s.PROJECT))
    return (
        ledger.where(condition(where))
        .where(is_capital())
        .select(F.col(s.CUI).alias("cui"), label.alias("label"))
        .distinct()
        .repartition("cui")  # without it the optimizer drops the distinct, since a maximum does not need it
        .groupBy("cui")
        .agg(F.max("label").alias("project_label"))
        .orderBy("project_label")
    )
