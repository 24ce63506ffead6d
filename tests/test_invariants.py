"""Properties that hold between queries, and on the cube as on the ledger."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks import ledgers
from fiscal_ledger import LedgerFilter, plans
from fiscal_ledger import schema as s
from tests.conftest import SF_DIR
from tests.micro import rows

ASIA_2000 = LedgerFilter(year=2000, level="ASIA")
ON_LEDGER = {
    name: getattr(plans, name)
    for name in entry_points.ledger_queries()
    if hasattr(plans, name) and name not in ("coercion_report", "monthly_cube", "years_available", "indexed_search")
}
ARGUMENTS = {"filter_options": (s.ENTITY,), "project_sheet": ("2000015",), "project_history": ("2000015",), "project_search": ("ring",)}


@pytest.fixture(scope="module")
def ledger(spark):
    return ledgers.typed_ledger(spark, SF_DIR)


@pytest.fixture(scope="module")
def cube(spark):
    return ledgers.cube_table(spark, SF_DIR)


@pytest.mark.parametrize("where", [None, ASIA_2000], ids=["all", "asia-2000"])
@pytest.mark.parametrize("name", sorted(ON_LEDGER))
def test_same_on_cube(ledger, cube, name, where):
    query, arguments = ON_LEDGER[name], ARGUMENTS.get(name, ())
    on_ledger = query(ledger, *arguments, where=where)
    on_cube = query(cube, *arguments, where=where)
    assert on_ledger.schema == on_cube.schema
    assert sorted(map(repr, on_ledger.collect())) == sorted(map(repr, on_cube.collect()))


def test_cube_is_smaller(ledger, cube):
    assert cube.count() * 2 <= ledger.count()


def test_years_on_cube(ledger, cube):
    assert rows(plans.years_available(ledger)) == rows(plans.years_available(cube))


def test_board_equals_single_indicators(ledger):
    for where in (None, ASIA_2000):
        board = plans.kpi_board(ledger, where).first().asDict()
        for query in (
            plans.kpi_summary,
            plans.kpi_ieg,
            plans.kpi_ieg_cap,
            plans.kpi_iopr,
            plans.kpi_idg,
            plans.kpi_iced,
            plans.kpi_iv_pim,
            plans.kpi_autonomy,
        ):
            single = query(ledger, where).first().asDict()
            assert single.items() <= board.items()


def test_last_running_sum_is_the_total(ledger):
    last = plans.cumulative_evolution(ledger).collect()[-1]
    total = plans.kpi_summary(ledger).first()
    assert (last.cumulative_committed, last.cumulative_accrued) == (total.committed_monthly, total.accrued)
    assert last.pct_accrued == total.accrued / total.pim * 100


def test_total_can_be_given(ledger):
    pim = plans.kpi_summary(ledger, ASIA_2000).first().pim
    given = plans.cumulative_evolution(ledger, ASIA_2000, total_pim=pim)
    assert rows(given) == rows(plans.cumulative_evolution(ledger, ASIA_2000))


def test_project_totals_sum_the_progress(ledger):
    progress = rows(plans.project_progress(ledger), "pim", "overrun")
    assert rows(plans.project_totals(ledger)) == [(len(progress), sum(p for p, _ in progress), sum(o for _, o in progress))]


def test_units_hold_the_whole_budget(ledger):
    units = sum(rows(plans.unit_ranking(ledger), "pim"))
    left_out = ledger.groupBy(s.UNIT).agg(F.sum(s.PIM).alias("pim")).where("pim <= 0").agg(F.coalesce(F.sum("pim"), F.lit(0.0)))
    assert units == rows(plans.kpi_summary(ledger), "pim")[0] - left_out.first()[0]


def test_top_lists_within_distribution(ledger):
    everything = sum(rows(plans.funding_function_distribution(ledger), "pim"))
    assert sum(rows(plans.top_funding_sources(ledger), "pim")) <= everything
    assert sum(rows(plans.top_functions(ledger, limit=100), "pim")) == everything


ORDERS = {
    "project_progress": ("accrued", True),
    "unit_ranking": ("accrued", True),
    "risk_ranking": ("pct", False),
    "lifecycle_audit": ("closing_pim", True),
    "breakdown_ieg": ("pct", True),
    "breakdown_iopr": ("pct", True),
    "breakdown_logistics": ("pct", True),
    "project_lookup": ("project_label", False),
    "project_list": ("project_label", False),
    "executing_units": ("unit_label", False),
    "budget_goals": ("goal_label", False),
    "years_available": ("fiscal_year", True),
    "top_functions": ("pim", False),
    "top_funding_sources": ("pim", False),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(ledger, name):
    column, descending = ORDERS[name]
    values = [v for v in rows(getattr(plans, name)(ledger), column) if v is not None]
    assert values == sorted(values, reverse=descending)
