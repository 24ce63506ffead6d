"""The query catalogue. Every query takes a ledger frame and returns a lazy frame."""

from fiscal_ledger.plans.cube import cube_batches, merge_into_cube, monthly_cube, write_cube
from fiscal_ledger.plans.distribution import (
    funding_function_distribution,
    top_functions,
    top_funding_sources,
    unit_ranking,
)
from fiscal_ledger.plans.evolution import closing_projection, cumulative_by, cumulative_evolution, monthly_curve
from fiscal_ledger.plans.kpis import (
    breakdown,
    breakdown_execution,
    breakdown_ieg,
    breakdown_ieg_cap,
    breakdown_iopr,
    breakdown_logistics,
    execution_overview,
    kpi_autonomy,
    kpi_board,
    kpi_iced,
    kpi_idg,
    kpi_ieg,
    kpi_ieg_cap,
    kpi_iopr,
    kpi_iv_pim,
    kpi_summary,
    verdict_components,
)
from fiscal_ledger.plans.lifecycle import lifecycle_audit
from fiscal_ledger.plans.lookups import (
    budget_goals,
    cascade_options,
    executing_units,
    filter_options,
    project_list,
    project_lookup,
    years_available,
)
from fiscal_ledger.plans.projects import (
    project_history,
    project_progress,
    project_search,
    project_sheet,
    project_totals,
    risk_ranking,
    spillover_alerts,
)
from fiscal_ledger.plans.quality import coercion_report
from fiscal_ledger.plans.routing import LedgerTables
from fiscal_ledger.plans.search import indexed_search, search_candidates

__all__ = [
    "LedgerTables",
    "breakdown",
    "breakdown_execution",
    "breakdown_ieg",
    "breakdown_ieg_cap",
    "breakdown_iopr",
    "breakdown_logistics",
    "budget_goals",
    "cascade_options",
    "closing_projection",
    "coercion_report",
    "cube_batches",
    "cumulative_by",
    "cumulative_evolution",
    "executing_units",
    "execution_overview",
    "filter_options",
    "funding_function_distribution",
    "indexed_search",
    "kpi_autonomy",
    "kpi_board",
    "kpi_iced",
    "kpi_idg",
    "kpi_ieg",
    "kpi_ieg_cap",
    "kpi_iopr",
    "kpi_iv_pim",
    "kpi_summary",
    "lifecycle_audit",
    "merge_into_cube",
    "monthly_cube",
    "monthly_curve",
    "project_history",
    "project_list",
    "project_lookup",
    "project_progress",
    "project_search",
    "project_sheet",
    "project_totals",
    "risk_ranking",
    "search_candidates",
    "spillover_alerts",
    "top_functions",
    "top_funding_sources",
    "unit_ranking",
    "verdict_components",
    "write_cube",
    "years_available",
]
