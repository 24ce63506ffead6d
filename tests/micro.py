"""Hand-written ledgers of a few raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscal_ledger import schema as s
from fiscal_ledger.sources import normalise

_CONSTANT = {
    s.YEAR: 2025,
    s.MONTH: "1",
    s.LEVEL: "GOBIERNO LOCAL",
    s.SECTOR: "EDUCACION",
    s.ENTITY: "PLIEGO 1",
    s.UNIT_CODE: "000001",
    s.UNIT: "UNIDAD 1",
    s.PROGRAMME: "0001",
    s.CUI: "2000001",
    s.PROJECT: "PROYECTO",
    s.FUNCTION: "SALUD",
    s.FUNDING_CODE: "00",
    s.FUNDING: "RECURSOS ORDINARIOS",
    s.EXPENSE_CLASS: "6",
    s.EXPENSE_CLASS_NAME: "GASTO DE CAPITAL",
    s.GOAL_CODE: "0001",
    s.GOAL: "META 1",
}
_RAW_SCHEMA = ", ".join(f"{c} {'int' if c == s.YEAR else 'string'}" for c in s.COLUMNS)


def raw_ledger(spark: SparkSession, *rows: dict[str, object]) -> DataFrame:
    """Rows that set only the columns a case is about; unset amounts are 0."""
    filled = [{**_CONSTANT, **{m: "0" for m in s.MEASURES}, **row} for row in rows]
    values = [
        tuple(v if v is None or isinstance(v, int) and c == s.YEAR else str(v) for c, v in ((c, row[c]) for c in s.COLUMNS))
        for row in filled
    ]
    return spark.createDataFrame(values, _RAW_SCHEMA)


def ledger(spark: SparkSession, *rows: dict[str, object]) -> DataFrame:
    return normalise(raw_ledger(spark, *rows))


def rows(frame: DataFrame, *columns: str) -> list:
    """Result rows in order, as tuples, or as values for a single column."""
    collected = frame.select(*columns).collect() if columns else frame.collect()
    return [row[0] if len(columns) == 1 else tuple(row) for row in collected]
