"""Which table answers a query: the ledger, or its cube where that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fiscal_ledger import schema as s
from fiscal_ledger.operators.filters import LedgerFilter, Where
from fiscal_ledger.plans import distribution, evolution, kpis, lifecycle, lookups, projects

Query = Callable[..., DataFrame]

# What a query must not be routed for: its answer depends on single lines, not on sums per dimension.
_OF_LINES: frozenset[str] = frozenset({"coercion_report", "monthly_cube"})


@dataclass(frozen=True)
class LedgerTables:
    """A ledger with its cube, if there is one.

    All catalogue queries use sums, minima, maxima and distinct values over the contract's dimensions, so they answer alike on both. The
    rule sends a query to the cube when

    * there is a cube,
    * the selection names dimensions only: an amount in a condition selects lines, which the cube has summed, and
    * the cube has every year of the ledger (looked up once per object).
    """

    ledger: DataFrame
    cube: DataFrame | None = None

    def _names_dimensions_only(self, where: Where) -> bool:
        if where is None or isinstance(where, LedgerFilter):
            return True
        try:
            dimensions = T.StructType([field for field in s.LEDGER_SCHEMA if field.name in s.DIMENSIONS])
            self.cube.sparkSession.createDataFrame([], dimensions).where(where).schema  # noqa: B018
        except AnalysisException:
            return False
        return True

    @cached_property
    def _cube_is_complete(self) -> bool:
        missing = self.ledger.select(s.YEAR).distinct().exceptAll(self.cube.select(s.YEAR).distinct())
        return missing.isEmpty()

    def table_for(self, query: Query, where: Where = None) -> DataFrame:
        """The table the query is to run on."""
        usable = self.cube is not None and query.__name__ not in _OF_LINES
        return self.cube if usable and self._names_dimensions_only(where) and self._cube_is_complete else self.ledger

    def run(self, query: Query, *arguments: object, where: Where = None, **options: object) -> DataFrame:
        """A catalogue query on the table that answers it with the least reading."""
        table = self.table_for(query, where)
        return query(table, *arguments, where=where, **options) if where is not None else query(table, *arguments, **options)

    def page(self, where: LedgerFilter | None = None, cui: str | None = None) -> dict[str, DataFrame]:
        """Everything a page of the audit shows for one selection, each as a lazy frame, all from the same table.

        The board has the summary and every indicator from one scan. Life-of-project queries run over all years.
        """
        where = where or LedgerFilter()
        of_years = where.without_year()
        page = {
            "years_available": self.run(lookups.years_available),
            "kpi_board": self.run(kpis.kpi_board, where=where),
            "execution_overview": self.run(kpis.execution_overview, where=where),
            "verdict_components": self.run(kpis.verdict_components, where=where),
            "monthly_curve": self.run(evolution.monthly_curve, where=where),
            "project_progress": self.run(projects.project_progress, where=where),
            "project_totals": self.run(projects.project_totals, where=where),
            "spillover_alerts": self.run(projects.spillover_alerts, where=where),
            "top_funding_sources": self.run(distribution.top_funding_sources, where=where),
            "top_functions": self.run(distribution.top_functions, where=where),
            "project_lookup": self.run(lookups.project_lookup, where=of_years),
            "lifecycle_audit": self.run(lifecycle.lifecycle_audit, where=of_years),
        }
        if cui is not None:
            page["project_sheet"] = self.run(projects.project_sheet, cui, where=of_years)
            page["project_history"] = self.run(projects.project_history, cui, where=of_years)
        return page
