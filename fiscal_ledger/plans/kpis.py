"""Efficiency indicators of a selection and their breakdown by executing unit.

The indicators are ratios of a few sums. The sums and formulas are stated
once, so a single indicator, the board of all indicators (one scan for all
of them) and the breakdowns share them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.functions.ratios import guarded_pct, nullif_pct
from fiscal_ledger.operators.filters import Where, condition, is_capital, outside_overhead
from fiscal_ledger.operators.totals import Sum, key, sum_where, totals

_MEASURE = {s.ALIASES[m]: m for m in s.MEASURES}
_CAPITAL = "capital_"


def _sum(name: str, sum_of: Sum = F.sum) -> Column:
    """A sum an indicator needs, under its name.

    The capital sums are NULL without capital rows, as if the other rows had
    been filtered out; the December, result and own-revenue sums are then 0.
    """
    if name.startswith(_CAPITAL):
        value = sum_of(F.when(is_capital(), F.col(_MEASURE[name.removeprefix(_CAPITAL)])))
    elif name == "december_accrued":
        value = sum_where(F.col(s.MONTH) == s.DECEMBER, s.ACCRUED, sum_of)
    elif name == "results_accrued":
        value = sum_where(outside_overhead(), s.ACCRUED, sum_of)
    elif name == "own_revenue_accrued":
        value = sum_where(F.col(s.FUNDING_CODE) == s.OWN_REVENUE_FUNDING, s.ACCRUED, sum_of)
    else:
        value = sum_of(F.col(_MEASURE[name]))
    return value.alias(name)


@dataclass(frozen=True)
class Indicator:
    """100 x part / whole over named sums; a variation uses (part - whole) as its numerator."""

    part: str
    whole: str
    capital: bool = False
    variation: bool = False

    def sums(self) -> tuple[str, str]:
        return self.part, self.whole

    def percentage(self) -> Column:
        part, whole = F.col(self.part), F.col(self.whole)
        return guarded_pct(part - whole if self.variation else part, whole)


INDICATORS = {
    "ieg": Indicator("accrued", "pim"),
    "ieg_cap": Indicator("capital_accrued", "capital_pim", capital=True),
    "iopr": Indicator("results_accrued", "accrued"),
    "idg_logistics": Indicator("committed_annual", "certified"),
    "idg_execution": Indicator("accrued", "committed_annual"),
    "iced": Indicator("december_accrued", "accrued"),
    "iv_pim": Indicator("capital_pim", "capital_pia", capital=True, variation=True),
    "autonomy": Indicator("own_revenue_accrued", "accrued"),
}


def _needed(indicators: Iterable[Indicator]) -> list[str]:
    return list(dict.fromkeys(name for indicator in indicators for name in indicator.sums()))


def _indicators(ledger: DataFrame, where: Where, *names: str) -> DataFrame:
    chosen = [INDICATORS[name] for name in names]
    rows = ledger.where(condition(where))
    if all(indicator.capital for indicator in chosen):
        rows = rows.where(is_capital())
    return rows.agg(*[_sum(name) for name in _needed(chosen)]).select(
        *[indicator.percentage().alias(name) for name, indicator in zip(names, chosen, strict=True)]
    )


def kpi_summary(ledger: DataFrame, where: Where = None, sum_of: Sum = F.sum) -> DataFrame:
    """Sums of the seven measures."""
    return ledger.where(condition(where)).agg(*totals(*s.MEASURES, sum_of=sum_of))


def kpi_ieg(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Execution efficiency: accrued over modified budget."""
    return _indicators(ledger, where, "ieg")


def kpi_ieg_cap(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Execution efficiency of the capital class."""
    return _indicators(ledger, where, "ieg_cap")


def kpi_iopr(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Share of accrued spending in result-oriented programmes."""
    return _indicators(ledger, where, "iopr")


def kpi_idg(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Spending fluidity: committed over certified, and accrued over committed."""
    return _indicators(ledger, where, "idg_logistics", "idg_execution")


def kpi_iced(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Share of accrued spending that falls in December."""
    return _indicators(ledger, where, "iced")


def kpi_iv_pim(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Variation of the capital budget from opening to modified."""
    return _indicators(ledger, where, "iv_pim")


def kpi_autonomy(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Share of accrued spending funded by own revenue."""
    return _indicators(ledger, where, "autonomy")


def kpi_board(ledger: DataFrame, where: Where = None, sum_of: Sum = F.sum) -> DataFrame:
    """The seven sums and all indicators from one scan and one aggregation."""
    sums = dict.fromkeys([*_MEASURE, *_needed(INDICATORS.values())])
    summed = ledger.where(condition(where)).agg(*[_sum(name, sum_of) for name in sums])
    return summed.select(
        *[s.ALIASES[m] for m in s.MEASURES],
        *[indicator.percentage().alias(name) for name, indicator in INDICATORS.items()],
    )


def verdict_components(ledger: DataFrame, where: Where = None) -> DataFrame:
    """The five sums that explain the management verdict; capital sums are 0 without capital rows."""
    return ledger.where(condition(where)).agg(
        sum_where(is_capital(), s.PIM).alias("capital_pim"),
        sum_where(is_capital(), s.ACCRUED).alias("capital_accrued"),
        _sum("accrued"),
        _sum("december_accrued"),
        _sum("results_accrued"),
    )


def execution_overview(ledger: DataFrame, where: Where = None, low_below: float = 50.0) -> DataFrame:
    """Budget, accrued, execution percentage and whether it is low."""
    return (
        ledger.where(condition(where))
        .agg(*totals(s.PIM, s.ACCRUED))
        .withColumn("pct", guarded_pct(F.col("accrued"), F.col("pim")))
        .withColumn("low", F.coalesce(F.col("pct") < low_below, F.lit(False)))
    )


BREAKDOWNS = {
    "ieg": Indicator("accrued", "pim"),
    "ieg_cap": Indicator("accrued", "pim", capital=True),
    "iopr": Indicator("results_accrued", "accrued"),
    "logistics": Indicator("committed_annual", "certified"),
    "execution": Indicator("accrued", "committed_annual"),
}


def breakdown(ledger: DataFrame, kind: str, where: Where = None, sum_of: Sum = F.sum) -> DataFrame:
    """An indicator per executing unit, best first; units whose denominator is not positive are left out."""
    if kind not in BREAKDOWNS:
        raise ValueError(f"unknown breakdown {kind!r}; expected one of {sorted(BREAKDOWNS)}")
    indicator = BREAKDOWNS[kind]
    rows = ledger.where(condition(where))
    if indicator.capital:
        rows = rows.where(is_capital())
    return (
        rows.groupBy(key(s.UNIT))
        .agg(_sum(indicator.whole, sum_of), _sum(indicator.part, sum_of))
        .where(F.col(indicator.whole) > 0)
        .withColumn("pct", nullif_pct(F.col(indicator.part), F.col(indicator.whole)))
        .orderBy(F.desc_nulls_last("pct"), F.asc_nulls_last("unit"))
    )


def breakdown_ieg(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Execution efficiency per unit."""
    return breakdown(ledger, "ieg", where)


def breakdown_ieg_cap(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Execution efficiency of the capital class per unit."""
    return breakdown(ledger, "ieg_cap", where)


def breakdown_iopr(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Result-oriented share per unit."""
    return breakdown(ledger, "iopr", where)


def breakdown_logistics(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Committed over certified per unit."""
    return breakdown(ledger, "logistics", where)


def breakdown_execution(ledger: DataFrame, where: Where = None) -> DataFrame:
    """Accrued over committed per unit."""
    return breakdown(ledger, "execution", where)
