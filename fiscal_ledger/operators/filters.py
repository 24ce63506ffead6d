"""Row filters: the hierarchy cascade, the capital class and the project search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscal_ledger import schema as s


@dataclass(frozen=True)
class LedgerFilter:
    """Year, government level, sector, entity and executing-unit code, all optional.

    Each set field is one equality and the result is their conjunction.
    ``None`` and "Todos" select everything, and so does a zero year. Values are bound
    as literals, so quotes in names need no care.
    """

    year: int | None = None
    level: str | None = None
    sector: str | None = None
    entity: str | None = None
    unit: str | None = None

    def to_column(self) -> Column:
        condition = F.lit(True)
        if self.year:
            condition = condition & (F.col(s.YEAR) == F.lit(int(self.year)))
        for column, value in (
            (s.LEVEL, self.level),
            (s.SECTOR, self.sector),
            (s.ENTITY, self.entity),
            (s.UNIT_CODE, self.unit),
        ):
            if value is not None and value != s.ALL:
                condition = condition & (F.col(column) == F.lit(value))
        return condition

    def without_year(self) -> LedgerFilter:
        """The same selection over all years, for life-of-project queries."""
        return replace(self, year=None)

    def with_unit_label(self, label: str) -> LedgerFilter:
        """Narrow to the unit of a ``code - name`` label as listed by ``executing_units``."""
        return replace(self, unit=label if label == s.ALL else label.split(s.LABEL_SEPARATOR)[0])


Where = LedgerFilter | Column | None


def condition(where: Where) -> Column:
    """A filter argument as a Column; no filter is TRUE, which the optimizer removes."""
    if where is None:
        return F.lit(True)
    if isinstance(where, LedgerFilter):
        return where.to_column()
    return where


def is_capital() -> Column:
    return F.col(s.EXPENSE_CLASS) == s.CAPITAL_CLASS


def outside_overhead() -> Column:
    """TRUE for result-oriented programmes, NULL where the programme is unknown."""
    return ~F.col(s.PROGRAMME).cast("string").isin(*s.OVERHEAD_PROGRAMMES)


def matches_search(text: str | None, name: Column, cui: Column) -> Column:
    """Regular-expression search, ignoring case in the name but not in the CUI.

    An empty text matches everything. A project without a name is never
    found, not even by its CUI.
    """
    if not text:
        return F.lit(True)
    return name.isNotNull() & (name.rlike("(?iU)" + text) | cui.cast("string").rlike("(?U)" + text))
