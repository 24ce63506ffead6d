"""The registered queries in SQL, over the same tables.

The ledger is written out as a common table expression; the queries below it
state the expected result independently of the DataFrame code.
"""

from __future__ import annotations

RAW = """
SELECT
  CAST(year(l_shipdate) AS INT) AS ANO_EJE,
  CASE WHEN l_orderkey % 97 = 0 THEN 'S/M' ELSE CAST(month(l_shipdate) AS STRING) END AS MES_EJE,
  r_name AS NIVEL_GOBIERNO_NOMBRE,
  n_name AS SECTOR_NOMBRE,
  'PLIEGO ' || CAST(n_nationkey AS STRING) || '/' || CAST(s_suppkey % 3 AS STRING) AS PLIEGO_NOMBRE,
  lpad(CAST(s_suppkey AS STRING), 6, '0') AS SEC_EJEC,
  s_name AS EJECUTORA_NOMBRE,
  CASE p_brand WHEN 'Brand#1' THEN '9001' WHEN 'Brand#2' THEN '9002' WHEN 'Brand#3' THEN NULL
       ELSE lpad(substring(p_brand, 7), 4, '0') END AS PROGRAMA_PPTO,
  CASE WHEN p_partkey % 50 = 0 THEN '3999999' WHEN p_partkey % 211 = 7 THEN NULL
       ELSE CAST(2000000 + p_partkey AS STRING) END AS PRODUCTO_PROYECTO,
  CASE WHEN p_partkey % 37 = 3 THEN NULL ELSE p_name END AS PRODUCTO_PROYECTO_NOMBRE,
  p_type AS FUNCION_NOMBRE,
  CASE l_linenumber WHEN 1 THEN '00' WHEN 2 THEN '09' WHEN 3 THEN '07' WHEN 4 THEN '08'
       WHEN 5 THEN '13' WHEN 6 THEN '18' ELSE '19' END AS RUBRO,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE 'RUBRO ' || CAST(l_linenumber AS STRING) END AS RUBRO_NOMBRE,
  CASE WHEN p_size % 3 = 0 THEN '6' WHEN p_size % 3 = 1 THEN '5' ELSE '7' END AS CATEGORIA_GASTO,
  CASE WHEN p_size % 3 = 0 THEN 'GASTO DE CAPITAL' WHEN p_size % 3 = 1 THEN 'GASTO CORRIENTE'
       ELSE 'SERVICIO DE LA DEUDA' END AS CATEGORIA_GASTO_NOMBRE,
  lpad(CAST(l_orderkey % 40 AS STRING), 4, '0') AS SEC_FUNC,
  'META ' || CAST(l_orderkey % 40 AS STRING) AS META_NOMBRE,
  CASE WHEN half = 0 THEN CAST(CAST(pia AS BIGINT) AS STRING) END AS MONTO_PIA,
  CASE WHEN half = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 'N/D' ELSE CAST(CAST(pim AS BIGINT) AS STRING) END AS MONTO_PIM,
  CASE WHEN half = 1 THEN CAST(CAST(cert AS BIGINT) AS STRING) END AS MONTO_CERTIFICADO,
  CASE WHEN half = 1 THEN CAST(CAST(floor(cert * 8 / 10) AS BIGINT) AS STRING) END AS MONTO_COMPROMETIDO_ANUAL,
  CASE WHEN half = 1 THEN CAST(CAST(floor(cert * 6 / 10) AS BIGINT) AS STRING) END AS MONTO_COMPROMETIDO,
  CASE WHEN half = 1 THEN CAST(CAST(dev AS BIGINT) AS STRING) END AS MONTO_DEVENGADO,
  CASE WHEN half = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN '' ELSE CAST(CAST(floor(dev * 95 / 100) AS BIGINT) AS STRING) END AS MONTO_GIRADO
FROM (
  SELECT *, CASE l_returnflag WHEN 'A' THEN floor(cert * 7 / 10) WHEN 'N' THEN floor(cert * 4 / 10) ELSE 0 END AS dev
  FROM (
    SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE floor(pim * 9 / 10) END AS cert
    FROM (
      SELECT *,
        CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE floor(l_extendedprice) END AS pia,
        CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE floor(l_extendedprice) + 500 * floor(l_quantity) END AS pim
      FROM lineitem
      JOIN supplier ON s_suppkey = l_suppkey
      JOIN nation ON n_nationkey = s_nationkey
      JOIN region ON r_regionkey = n_regionkey
      JOIN part ON p_partkey = l_partkey
    ) a
  ) b
) c CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1 AS half) halves
"""

MEASURES = {
    "pia": "MONTO_PIA",
    "pim": "MONTO_PIM",
    "certified": "MONTO_CERTIFICADO",
    "committed_annual": "MONTO_COMPROMETIDO_ANUAL",
    "committed_monthly": "MONTO_COMPROMETIDO",
    "accrued": "MONTO_DEVENGADO",
    "paid": "MONTO_GIRADO",
}
DIMENSIONS = (
    "ANO_EJE, MES_EJE, NIVEL_GOBIERNO_NOMBRE, SECTOR_NOMBRE, PLIEGO_NOMBRE, SEC_EJEC, EJECUTORA_NOMBRE, "
    "PROGRAMA_PPTO, PRODUCTO_PROYECTO, PRODUCTO_PROYECTO_NOMBRE, FUNCION_NOMBRE, RUBRO, RUBRO_NOMBRE, "
    "CATEGORIA_GASTO, CATEGORIA_GASTO_NOMBRE, SEC_FUNC, META_NOMBRE"
)
COERCIONS = {**{c: "DOUBLE" for c in MEASURES.values()}, "CATEGORIA_GASTO": "INTEGER", "MES_EJE": "INTEGER"}


def ledger_prefix(raw: str) -> str:
    """Common table expressions for the raw and the coerced ledger."""
    coerced = ", ".join(f"TRY_CAST({c} AS {t}) AS {c}" for c, t in COERCIONS.items())
    return f"WITH raw AS ({raw}),\nledger AS (SELECT * REPLACE ({coerced}) FROM raw)\n"


CAPITAL = "CATEGORIA_GASTO = 6"
RESULTS_ACCRUED = "SUM(CASE WHEN PROGRAMA_PPTO NOT IN ('9001', '9002') THEN MONTO_DEVENGADO ELSE 0 END)"
DECEMBER_ACCRUED = "SUM(CASE WHEN MES_EJE = 12 THEN MONTO_DEVENGADO ELSE 0 END)"
OWN_REVENUE_ACCRUED = "SUM(CASE WHEN RUBRO = '09' THEN MONTO_DEVENGADO ELSE 0 END)"


def total(name: str) -> str:
    return f"SUM({MEASURES[name]})"


def totals(*names: str) -> str:
    return ", ".join(f"{total(name)} AS {name}" for name in names)


def guarded(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 AND NOT isnan({whole}) THEN ({part}) / ({whole}) * 100 ELSE 0.0::DOUBLE END"


def or_zero(part: str, whole: str) -> str:
    """An unguarded percentage with NaN and NULL as 0."""
    pct = f"({part}) / ({whole}) * 100"
    return f"CASE WHEN isnan({pct}) OR ({pct}) IS NULL THEN 0.0::DOUBLE ELSE {pct} END"


def one_kpi(name: str, part: str, whole: str, where: str = "TRUE") -> str:
    return f"SELECT {guarded(part, whole)} AS {name} FROM ledger WHERE {where}"


def distinct_list(value: str, name: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT {value} AS {name} FROM ledger WHERE {where} ORDER BY {name}"


def label(code: str, name: str) -> str:
    return f"concat({code}, ' - ', {name})"


def breakdown(whole: tuple[str, str], part: tuple[str, str], where: str = "TRUE") -> str:
    return (
        f"SELECT EJECUTORA_NOMBRE AS unit, {whole[1]} AS {whole[0]}, {part[1]} AS {part[0]}, "
        f"({part[1]} / NULLIF({whole[1]}, 0)) * 100 AS pct "
        f"FROM ledger WHERE {where} GROUP BY EJECUTORA_NOMBRE HAVING {whole[1]} > 0 ORDER BY pct DESC"
    )


def pair(name: str) -> tuple[str, str]:
    return name, total(name)


STAGES = ("pia", "pim", "certified", "committed_annual", "accrued")

PROGRESS = f"""
SELECT *, {or_zero("accrued", "pim")} AS pct, pim - pia AS overrun FROM (
  SELECT PRODUCTO_PROYECTO AS cui, PRODUCTO_PROYECTO_NOMBRE AS project, {totals(*STAGES)}
  FROM ledger WHERE {{where}} AND {CAPITAL}
  GROUP BY PRODUCTO_PROYECTO, PRODUCTO_PROYECTO_NOMBRE HAVING SUM(MONTO_PIM) > 0
)
"""


def progress(where: str = "TRUE") -> str:
    return PROGRESS.format(where=where)


DISTRIBUTION = f"""
SELECT RUBRO_NOMBRE AS funding_source, FUNCION_NOMBRE AS function_name, {totals("pim", "accrued")}
FROM ledger GROUP BY RUBRO_NOMBRE, FUNCION_NOMBRE
"""


def largest(column: str) -> str:
    return f"""
SELECT {column}, pim, accrued, {or_zero("accrued", "pim")} AS pct FROM (
  SELECT {column}, coalesce(SUM(pim), 0) AS pim, coalesce(SUM(accrued), 0) AS accrued
  FROM ({DISTRIBUTION}) WHERE {column} IS NOT NULL GROUP BY {column}
) ORDER BY pim DESC, {column} LIMIT 5
"""


MONTH_NAME = (
    "CASE month WHEN 1 THEN 'Enero' WHEN 2 THEN 'Febrero' WHEN 3 THEN 'Marzo' WHEN 4 THEN 'Abril' "
    "WHEN 5 THEN 'Mayo' WHEN 6 THEN 'Junio' WHEN 7 THEN 'Julio' WHEN 8 THEN 'Agosto' WHEN 9 THEN 'Setiembre' "
    "WHEN 10 THEN 'Octubre' WHEN 11 THEN 'Noviembre' WHEN 12 THEN 'Diciembre' END"
)


def running(column: str) -> str:
    window = "OVER (ORDER BY month ASC NULLS LAST ROWS UNBOUNDED PRECEDING)"
    known = f"CASE WHEN NOT isnan({column}) THEN {column} END"
    return f"CASE WHEN {known} IS NOT NULL THEN SUM({known}) {window} ELSE {column} END"


CUMULATIVE = f"""
SELECT month, committed_monthly, accrued, cumulative_committed, cumulative_accrued,
  {guarded("cumulative_committed", "total_pim")} AS pct_committed,
  {guarded("cumulative_accrued", "total_pim")} AS pct_accrued,
  {MONTH_NAME} AS month_name
FROM (
  SELECT *, {running("committed_monthly")} AS cumulative_committed, {running("accrued")} AS cumulative_accrued,
    (SELECT SUM(MONTO_PIM) FROM ledger) AS total_pim
  FROM (SELECT MES_EJE AS month, {totals("committed_monthly", "accrued")} FROM ledger GROUP BY MES_EJE)
) ORDER BY month ASC NULLS LAST
"""

CLOSING = f"""
SELECT *, projected / pim * 100 AS pct_projected FROM (
  SELECT *, run_rate * 12 AS projected FROM (
    SELECT *, accrued / latest_month AS run_rate FROM (
      SELECT CATEGORIA_GASTO_NOMBRE AS expense_class, {totals("pim", "accrued")}, MAX(MES_EJE) AS latest_month
      FROM ledger GROUP BY CATEGORIA_GASTO_NOMBRE
    )
  )
)
"""

SPILLOVER = f"""
SELECT *, CASE WHEN certified = 0 THEN 'extreme' WHEN committed_annual / pim * 100 < 40 THEN 'medium'
  ELSE 'safe' END AS risk
FROM (
  SELECT PRODUCTO_PROYECTO_NOMBRE AS project, {totals("pim", "certified", "committed_annual", "accrued")},
    MAX(MES_EJE) AS latest_month
  FROM ledger WHERE {CAPITAL} GROUP BY PRODUCTO_PROYECTO_NOMBRE HAVING SUM(MONTO_PIM) > 0
)
"""

RISK = f"""
SELECT PRODUCTO_PROYECTO AS cui, PRODUCTO_PROYECTO_NOMBRE AS project, MAX(EJECUTORA_NOMBRE) AS unit,
  {totals("pim", "accrued")}, (SUM(MONTO_DEVENGADO) / NULLIF(SUM(MONTO_PIM), 0)) * 100 AS pct
FROM ledger WHERE {CAPITAL}
GROUP BY PRODUCTO_PROYECTO, PRODUCTO_PROYECTO_NOMBRE HAVING SUM(MONTO_PIM) > 0
ORDER BY pct ASC NULLS LAST, cui ASC NULLS LAST, project ASC NULLS LAST LIMIT 50
"""


def sheet(cui: str) -> str:
    return f"""
SELECT *, coalesce(pct < 30, FALSE) AS low, coalesce(pim > 0 AND pct < 15, FALSE) AS critical FROM (
  SELECT *, {guarded("accrued", "pim")} AS pct FROM (
    SELECT PRODUCTO_PROYECTO AS cui, MAX(PRODUCTO_PROYECTO_NOMBRE) AS project, MAX(EJECUTORA_NOMBRE) AS unit,
      MAX(FUNCION_NOMBRE) AS function_name, {totals(*STAGES)}
    FROM ledger WHERE {CAPITAL} AND PRODUCTO_PROYECTO = '{cui}' GROUP BY PRODUCTO_PROYECTO
  )
)
"""


def history(cui: str) -> str:
    return f"""
SELECT *, {or_zero("accrued", "pim")} AS pct FROM (
  SELECT ANO_EJE AS fiscal_year, {totals(*STAGES)}
  FROM ledger WHERE {CAPITAL} AND PRODUCTO_PROYECTO = '{cui}' GROUP BY ANO_EJE
) ORDER BY fiscal_year
"""


LIFECYCLE = f"""
SELECT cui, MAX(project) AS project, MIN(fiscal_year) AS first_year, MAX(fiscal_year) AS last_year,
  SUM(accrued) AS total_accrued, arg_min(pia, fiscal_year) AS opening_pia, arg_max(pim, fiscal_year) AS closing_pim
FROM (
  SELECT PRODUCTO_PROYECTO AS cui, MAX(PRODUCTO_PROYECTO_NOMBRE) AS project, ANO_EJE AS fiscal_year,
    {totals("pia", "pim", "accrued")}
  FROM ledger WHERE PRODUCTO_PROYECTO != '3999999' GROUP BY PRODUCTO_PROYECTO, ANO_EJE
) GROUP BY cui ORDER BY closing_pim DESC
"""

COERCION_REPORT = " UNION ALL ".join(
    f"SELECT ANO_EJE AS fiscal_year, '{c}' AS column_name, COUNT({c}) AS present, "
    f"COUNT({c}) - COUNT(TRY_CAST({c} AS {t})) AS rejected FROM raw GROUP BY ANO_EJE"
    for c, t in COERCIONS.items()
)

CUBE = (
    f"SELECT {DIMENSIONS}, " + ", ".join(f"SUM({c}) AS {c}" for c in MEASURES.values()) + " FROM ledger "
    f"GROUP BY {DIMENSIONS}"
)

CAPITAL_SUM = {name: f"SUM(CASE WHEN {CAPITAL} THEN {MEASURES[name]} END)" for name in ("pia", "pim", "accrued")}

BOARD = (
    f"SELECT {totals(*MEASURES)}, "
    f"{guarded(total('accrued'), total('pim'))} AS ieg, "
    f"{guarded(CAPITAL_SUM['accrued'], CAPITAL_SUM['pim'])} AS ieg_cap, "
    f"{guarded(RESULTS_ACCRUED, total('accrued'))} AS iopr, "
    f"{guarded(total('committed_annual'), total('certified'))} AS idg_logistics, "
    f"{guarded(total('accrued'), total('committed_annual'))} AS idg_execution, "
    f"{guarded(DECEMBER_ACCRUED, total('accrued'))} AS iced, "
    f"{guarded(CAPITAL_SUM['pim'] + ' - ' + CAPITAL_SUM['pia'], CAPITAL_SUM['pia'])} AS iv_pim, "
    f"{guarded(OWN_REVENUE_ACCRUED, total('accrued'))} AS autonomy FROM ledger"
)

VERDICT = (
    f"SELECT SUM(CASE WHEN {CAPITAL} THEN MONTO_PIM ELSE 0 END) AS capital_pim, "
    f"SUM(CASE WHEN {CAPITAL} THEN MONTO_DEVENGADO ELSE 0 END) AS capital_accrued, "
    f"SUM(MONTO_DEVENGADO) AS accrued, {DECEMBER_ACCRUED} AS december_accrued, "
    f"{RESULTS_ACCRUED} AS results_accrued FROM ledger"
)

OVERVIEW = (
    f"SELECT *, coalesce(pct < 50, FALSE) AS low FROM (SELECT *, {guarded('accrued', 'pim')} AS pct "
    f"FROM (SELECT {totals('pim', 'accrued')} FROM ledger))"
)

LOOKUP = (
    f"SELECT PRODUCTO_PROYECTO AS cui, MAX({label('PRODUCTO_PROYECTO', 'PRODUCTO_PROYECTO_NOMBRE')}) AS project_label "
    f"FROM ledger WHERE {CAPITAL} GROUP BY PRODUCTO_PROYECTO ORDER BY project_label"
)

TOTALS = (
    "SELECT COUNT(*) AS projects, coalesce(SUM(CASE WHEN NOT isnan(pim) THEN pim END), 0) AS pim, "
    "coalesce(SUM(CASE WHEN NOT isnan(overrun) THEN overrun END), 0) AS overrun "
    f"FROM ({progress()})"
)

CASCADE = (
    "ANO_EJE = 2000 AND NIVEL_GOBIERNO_NOMBRE = 'ASIA' AND SECTOR_NOMBRE = 'NATION_7' "
    "AND PLIEGO_NOMBRE = 'PLIEGO 7/0'"
)

# Each selector's options under the choices above it, one query each.
CASCADE_OPTIONS = " UNION ALL ".join(
    f"SELECT DISTINCT CAST({position} AS INTEGER) AS position, '{selector}' AS selector, {value} AS option FROM ledger "
    f"WHERE {where} AND {value} IS NOT NULL"
    for position, (selector, value, where) in enumerate(
        (
            ("year", "CAST(ANO_EJE AS VARCHAR)", "TRUE"),
            ("level", "NIVEL_GOBIERNO_NOMBRE", "ANO_EJE = 2000"),
            ("sector", "SECTOR_NOMBRE", "ANO_EJE = 2000 AND NIVEL_GOBIERNO_NOMBRE = 'ASIA'"),
            ("entity", "PLIEGO_NOMBRE", "ANO_EJE = 2000 AND NIVEL_GOBIERNO_NOMBRE = 'ASIA' AND SECTOR_NOMBRE = 'NATION_7'"),
            ("unit", label("SEC_EJEC", "EJECUTORA_NOMBRE"), CASCADE),
        ),
        1,
    )
)


def cumulative_by(keys: dict[str, str]) -> str:
    """The running sums of every entity over all twelve months and the lines without one."""
    columns = ", ".join(f"{column} AS {name}" for name, column in keys.items())
    names = ", ".join(keys)
    matching = " AND ".join(f"s.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
    window = f"OVER (PARTITION BY {names} ORDER BY month ASC NULLS LAST ROWS UNBOUNDED PRECEDING)"
    running = {c: f"CASE WHEN {c} IS NOT NULL THEN SUM({c}) {window} END" for c in ("committed_monthly", "accrued")}
    return f"""
SELECT {names}, month, lines, committed_monthly, accrued, cumulative_committed, cumulative_accrued,
  {guarded("cumulative_committed", "base")} AS pct_committed, {guarded("cumulative_accrued", "base")} AS pct_accrued, {MONTH_NAME} AS month_name
FROM (
  SELECT *, {running["committed_monthly"]} AS cumulative_committed, {running["accrued"]} AS cumulative_accrued,
    SUM(pim) OVER (PARTITION BY {names}) AS base
  FROM (
    SELECT {", ".join(f"s.{k}" for k in keys)}, s.month, coalesce(m.lines, 0) AS lines, m.pim,
      CASE WHEN m.lines IS NULL THEN 0 ELSE m.committed_monthly END AS committed_monthly,
      CASE WHEN m.lines IS NULL THEN 0 ELSE m.accrued END AS accrued
    FROM (
      SELECT DISTINCT {columns}, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM ledger
      UNION SELECT DISTINCT {columns}, MES_EJE AS month FROM ledger
    ) s LEFT JOIN (
      SELECT {columns}, MES_EJE AS month, COUNT(*) AS lines, {totals("committed_monthly", "accrued", "pim")} FROM ledger GROUP BY ALL
    ) m ON {matching} AND s.month IS NOT DISTINCT FROM m.month
  )
)
"""


_QUERIES = {
    "cascade_options": CASCADE_OPTIONS,
    "cumulative_by_entity": cumulative_by({"entity": "PLIEGO_NOMBRE"}),
    "cumulative_by_year_and_sector": cumulative_by({"fiscal_year": "ANO_EJE", "sector": "SECTOR_NOMBRE"}),
    "ledger_scan": "SELECT * FROM raw",
    "ledger_normalised": "SELECT * FROM ledger",
    "ledger_ingest": "SELECT * FROM ledger",
    "coercion_report": COERCION_REPORT,
    "monthly_cube": CUBE,
    "filter_cascade": f"SELECT * FROM ledger WHERE {CASCADE}",
    "filter_cascade_unit": "SELECT * FROM ledger WHERE ANO_EJE = 2000 AND SEC_EJEC = '000006'",
    "filter_options": distinct_list("PLIEGO_NOMBRE", "option", "PLIEGO_NOMBRE IS NOT NULL"),
    "filter_options_cascade": distinct_list(
        "SECTOR_NOMBRE",
        "option",
        "ANO_EJE = 2000 AND NIVEL_GOBIERNO_NOMBRE = 'ASIA' AND SECTOR_NOMBRE IS NOT NULL",
    ),
    "years_available": "SELECT DISTINCT ANO_EJE AS fiscal_year FROM ledger WHERE ANO_EJE IS NOT NULL "
    "ORDER BY fiscal_year DESC",
    "executing_units": distinct_list(label("SEC_EJEC", "EJECUTORA_NOMBRE"), "unit_label"),
    "budget_goals": distinct_list(label("SEC_FUNC", "META_NOMBRE"), "goal_label"),
    "project_list": distinct_list(label("PRODUCTO_PROYECTO", "PRODUCTO_PROYECTO_NOMBRE"), "project_label", CAPITAL),
    "project_lookup": LOOKUP,
    "kpi_summary": f"SELECT {totals(*MEASURES)} FROM ledger",
    "kpi_ieg": one_kpi("ieg", total("accrued"), total("pim")),
    "kpi_ieg_cap": one_kpi("ieg_cap", total("accrued"), total("pim"), CAPITAL),
    "kpi_iopr": one_kpi("iopr", RESULTS_ACCRUED, total("accrued")),
    "kpi_idg": f"SELECT {guarded(total('committed_annual'), total('certified'))} AS idg_logistics, "
    f"{guarded(total('accrued'), total('committed_annual'))} AS idg_execution FROM ledger",
    "kpi_iced": one_kpi("iced", DECEMBER_ACCRUED, total("accrued")),
    "kpi_iv_pim": one_kpi("iv_pim", f"{total('pim')} - {total('pia')}", total("pia"), CAPITAL),
    "kpi_autonomy": one_kpi("autonomy", OWN_REVENUE_ACCRUED, total("accrued")),
    "kpi_board": BOARD,
    "verdict_components": VERDICT,
    "execution_overview": OVERVIEW,
    "breakdown_ieg": breakdown(pair("pim"), pair("accrued")),
    "breakdown_ieg_cap": breakdown(pair("pim"), pair("accrued"), CAPITAL),
    "breakdown_iopr": breakdown(pair("accrued"), ("results_accrued", RESULTS_ACCRUED)),
    "breakdown_logistics": breakdown(pair("certified"), pair("committed_annual")),
    "breakdown_execution": breakdown(pair("committed_annual"), pair("accrued")),
    "project_sheet": sheet("2000015"),
    "project_history": history("2000015"),
    "risk_ranking": RISK,
    "project_progress": progress() + " ORDER BY accrued DESC",
    "project_totals": TOTALS,
    "project_search": f"SELECT * FROM ({progress()}) WHERE project IS NOT NULL "
    "AND (regexp_matches(project, 'ring', 'i') OR regexp_matches(cui, 'ring'))",
    "spillover_alerts": SPILLOVER,
    "monthly_curve": f"SELECT MES_EJE AS month, {totals('certified', 'committed_annual', 'accrued', 'paid')} "
    "FROM ledger GROUP BY MES_EJE ORDER BY month ASC NULLS LAST",
    "cumulative_evolution": CUMULATIVE,
    "closing_projection": CLOSING,
    "unit_ranking": f"SELECT EJECUTORA_NOMBRE AS unit, {totals(*STAGES)} FROM ledger GROUP BY EJECUTORA_NOMBRE "
    "HAVING SUM(MONTO_PIM) > 0 ORDER BY accrued DESC",
    "funding_function_distribution": DISTRIBUTION,
    "top_funding_sources": largest("funding_source"),
    "top_functions": largest("function_name"),
    "lifecycle_audit": LIFECYCLE,
}


# The same queries on a ledger with amounts that are no numbers.
WITH_NAN = ("kpi_board", "project_totals", "cumulative_evolution", "execution_overview", "project_history")


def _nan_prefix() -> str:
    odd = "PRODUCTO_PROYECTO = '2000015' AND MES_EJE = 5"
    amounts = ", ".join(
        f"CASE WHEN {odd} THEN 'NaN'::DOUBLE ELSE {c} END AS {c}" for c in ("MONTO_PIA", "MONTO_PIM", "MONTO_DEVENGADO")
    )
    coerced = ledger_prefix(RAW).replace("\nledger AS (", "\nnumbers AS (")
    return coerced.rstrip() + f",\nledger AS (SELECT * REPLACE ({amounts}) FROM numbers)\n"


def oracle_sql() -> dict[str, str]:
    prefix = ledger_prefix(RAW)
    found = {name: prefix + query for name, query in _QUERIES.items()} | exact_sql()
    same = {  # other tables or routes to the same answers
        "ledger_scan_many_files": "ledger_normalised",
        "merged_cube": "monthly_cube",
        "unsorted_project_sheet": "project_sheet",
        "unsorted_project_history": "project_history",
        "coded_risk_ranking": "risk_ranking",
        "indexed_search": "project_search",
        "routed_kpi_board": "kpi_board",
        "routed_monthly_curve": "monthly_curve",
        "routed_project_progress": "project_progress",
        "routed_spillover_alerts": "spillover_alerts",
        "routed_lifecycle_audit": "lifecycle_audit",
    }
    found |= {name: prefix + _QUERIES[query] for name, query in same.items()}
    return found | {f"nan_{name}": _nan_prefix() + _QUERIES[name] for name in WITH_NAN}


# Exact sums count 2^-78 in whole numbers of 128 bits; the count becomes a double by digits of 26 bits, highest first.
def _as_double(count: str) -> str:
    base = 1 << 26

    def digit(place: int) -> str:
        power = base**place
        return f"CAST((((({count} - ((({count} % {power}) + {power}) % {power})) // {power}) % {base}) + {base}) % {base} AS DOUBLE)"

    top_power = base**4
    top = f"CAST(({count} - ((({count} % {top_power}) + {top_power}) % {top_power})) // {top_power} AS DOUBLE)"
    return (
        f"({top} * 67108864 + ({digit(3)} + {digit(2)} / 67108864) "
        f"+ ({digit(1)} / pow(2, 52) + {digit(0)} / pow(2, 78)))"
    )


def exact_total(column: str) -> str:
    return _as_double(f"sum(CAST(round_even(({column}) * pow(2, 78), 0) AS HUGEINT))")


def _fraction_prefix() -> str:
    amounts = ", ".join(f"{c} / 7.0::DOUBLE AS {c}" for c in MEASURES.values())
    return ledger_prefix(RAW).replace("\nledger AS (", "\nnumbers AS (").rstrip() + f",\nledger AS (SELECT * REPLACE ({amounts}) FROM numbers)\n"


def exact_sql() -> dict[str, str]:
    """Queries with exact sums, on a ledger with fractions."""

    def totals(*names: str) -> str:
        return ", ".join(f"{exact_total(MEASURES[name])} AS {name}" for name in names)

    results = exact_total("CASE WHEN PROGRAMA_PPTO NOT IN ('9001', '9002') THEN MONTO_DEVENGADO ELSE 0 END")
    queries = {
        "exact_kpi_summary": f"SELECT {totals(*MEASURES)} FROM ledger",
        "exact_unit_ranking": f"SELECT * FROM (SELECT EJECUTORA_NOMBRE AS unit, {totals(*STAGES)} FROM ledger GROUP BY ALL) WHERE pim > 0",
        "exact_project_progress": f"SELECT *, {or_zero('accrued', 'pim')} AS pct, pim - pia AS overrun FROM (SELECT PRODUCTO_PROYECTO AS cui, "
        f"PRODUCTO_PROYECTO_NOMBRE AS project, {totals(*STAGES)} FROM ledger WHERE {CAPITAL} GROUP BY ALL) WHERE pim > 0",
        "exact_breakdown_iopr": "SELECT *, (results_accrued / NULLIF(accrued, 0)) * 100 AS pct FROM (SELECT EJECUTORA_NOMBRE AS unit, "
        f"{totals('accrued')}, {results} AS results_accrued FROM ledger GROUP BY ALL) WHERE accrued > 0",
    }
    return {name: _fraction_prefix() + query for name, query in queries.items()}
