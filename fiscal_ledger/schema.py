"""The column contract of the budget ledger and the codes the queries test for."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names, codes and month names of the published ledger format ---

YEAR = "ANO_EJE"
MONTH = "MES_EJE"
LEVEL = "NIVEL_GOBIERNO_NOMBRE"
SECTOR = "SECTOR_NOMBRE"
ENTITY = "PLIEGO_NOMBRE"
UNIT_CODE = "SEC_EJEC"
UNIT = "EJECUTORA_NOMBRE"
PROGRAMME = "PROGRAMA_PPTO"
CUI = "PRODUCTO_PROYECTO"
PROJECT = "PRODUCTO_PROYECTO_NOMBRE"
FUNCTION = "FUNCION_NOMBRE"
FUNDING_CODE = "RUBRO"
FUNDING = "RUBRO_NOMBRE"
EXPENSE_CLASS = "CATEGORIA_GASTO"
EXPENSE_CLASS_NAME = "CATEGORIA_GASTO_NOMBRE"
GOAL_CODE = "SEC_FUNC"
GOAL = "META_NOMBRE"

PIA = "MONTO_PIA"
PIM = "MONTO_PIM"
CERTIFIED = "MONTO_CERTIFICADO"
COMMITTED_ANNUAL = "MONTO_COMPROMETIDO_ANUAL"
COMMITTED_MONTHLY = "MONTO_COMPROMETIDO"
ACCRUED = "MONTO_DEVENGADO"
PAID = "MONTO_GIRADO"

CAPITAL_CLASS = 6
DECEMBER = 12
OWN_REVENUE_FUNDING = "09"
OVERHEAD_PROGRAMMES = ("9001", "9002")
CATCH_ALL_CUI = "3999999"
ALL = "Todos"

MONTH_NAMES = {
    1: "Enero",
    2: "Febrero",
    3: "Marzo",
    4: "Abril",
    5: "Mayo",
    6: "Junio",
    7: "Julio",
    8: "Agosto",
    9: "Setiembre",
    10: "Octubre",
    11: "Noviembre",
    12: "Diciembre",
}

LABEL_SEPARATOR = " - "

# --- End of fixed values ---

MEASURES = (PIA, PIM, CERTIFIED, COMMITTED_ANNUAL, COMMITTED_MONTHLY, ACCRUED, PAID)
WHOLE_NUMBERS = (MONTH, EXPENSE_CLASS)
COERCED = MEASURES + WHOLE_NUMBERS

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(MONTH, T.IntegerType()),
        T.StructField(LEVEL, T.StringType()),
        T.StructField(SECTOR, T.StringType()),
        T.StructField(ENTITY, T.StringType()),
        T.StructField(UNIT_CODE, T.StringType()),
        T.StructField(UNIT, T.StringType()),
        T.StructField(PROGRAMME, T.StringType()),
        T.StructField(CUI, T.StringType()),
        T.StructField(PROJECT, T.StringType()),
        T.StructField(FUNCTION, T.StringType()),
        T.StructField(FUNDING_CODE, T.StringType()),
        T.StructField(FUNDING, T.StringType()),
        T.StructField(EXPENSE_CLASS, T.IntegerType()),
        T.StructField(EXPENSE_CLASS_NAME, T.StringType()),
        T.StructField(GOAL_CODE, T.StringType()),
        T.StructField(GOAL, T.StringType()),
        *[T.StructField(measure, T.DoubleType()) for measure in MEASURES],
    ]
)
COLUMNS = tuple(LEDGER_SCHEMA.fieldNames())
DIMENSIONS = tuple(c for c in COLUMNS if c not in MEASURES)

# Names the query results use for the ledger columns.
ALIASES = {
    YEAR: "fiscal_year",
    MONTH: "month",
    LEVEL: "level",
    SECTOR: "sector",
    ENTITY: "entity",
    UNIT_CODE: "unit_code",
    UNIT: "unit",
    CUI: "cui",
    PROJECT: "project",
    FUNCTION: "function_name",
    FUNDING: "funding_source",
    EXPENSE_CLASS_NAME: "expense_class",
    PIA: "pia",
    PIM: "pim",
    CERTIFIED: "certified",
    COMMITTED_ANNUAL: "committed_annual",
    COMMITTED_MONTHLY: "committed_monthly",
    ACCRUED: "accrued",
    PAID: "paid",
}
