"""Physical plans: what reaches the scan, how often data is shuffled, and what must not appear."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks import ledgers
from checks.star import star_ledger
from fiscal_ledger import LedgerFilter, ledger_ingest, plans
from fiscal_ledger import schema as s
from fiscal_ledger.sources import normalise
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def ledger(spark):
    return ledgers.typed_ledger(spark, SF_DIR)


def plan(frame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def tree(frame) -> str:
    return plan(frame).split("\n\n")[0]


def shuffles(frame) -> int:
    return len(re.findall(r"\bExchange\b", tree(frame)))


def read_columns(frame) -> set[str]:
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", plan(frame)).group(1)))


def test_year_prunes_partitions(ledger):
    text = plan(plans.kpi_ieg(ledger, LedgerFilter(year=2000)))
    assert re.search(r"PartitionFilters: \[.*ANO_EJE#\d+ = 2000", text)


def test_filters_and_columns_reach_the_scan(ledger):
    frame = plans.project_progress(ledger, LedgerFilter(year=2000, level="ASIA", unit="000006"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan(frame)).group(1)
    for pushed_filter in ("EqualTo(CATEGORIA_GASTO,6)", "EqualTo(NIVEL_GOBIERNO_NOMBRE,ASIA)", "EqualTo(SEC_EJEC,000006)"):
        assert pushed_filter in pushed
    assert read_columns(plans.kpi_ieg(ledger)) == {s.ACCRUED, s.PIM}
    assert read_columns(plans.kpi_iv_pim(ledger)) == {s.PIA, s.PIM, s.EXPENSE_CLASS}
    assert read_columns(plans.executing_units(ledger)) == {s.UNIT_CODE, s.UNIT}
    assert "EqualTo(PRODUCTO_PROYECTO,2000015)" in plan(plans.project_sheet(ledger, "2000015"))


def test_columns_are_pruned_through_coercion(spark):
    raw = normalise(ledgers.yearly_scan(spark, SF_DIR))
    assert read_columns(plans.kpi_ieg(raw, LedgerFilter(year=2000))) == {s.ACCRUED, s.PIM, s.YEAR}


# A global aggregate, a key, a global sort and each further aggregation level cost one shuffle each.
SHUFFLES = {
    "kpi_board": 1,
    "kpi_summary": 1,
    "project_sheet": 1,
    "funding_function_distribution": 1,
    "spillover_alerts": 1,
    "closing_projection": 1,
    "risk_ranking": 1,
    "unit_ranking": 2,
    "project_progress": 2,
    "breakdown_iopr": 2,
    "project_list": 2,
    "project_totals": 2,
    "project_lookup": 3,
    "top_functions": 2,
    "lifecycle_audit": 3,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, name):
    assert shuffles(entry_points.ledger_queries()[name](spark, SF_DIR)) == SHUFFLES[name]


@pytest.mark.parametrize("name", sorted(entry_points.ledger_queries()))
def test_no_python_no_cross_join_no_broadcast_hint(spark, name):
    frame = entry_points.ledger_queries()[name](spark, SF_DIR)
    nodes = tree(frame)
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in nodes
    assert "broadcast" not in frame._jdf.queryExecution().logical().toString()


def test_top_k_is_not_a_full_sort(ledger):
    nodes = tree(plans.risk_ranking(ledger))
    assert "TakeOrderedAndProject" in nodes


def test_lifecycle_rows_are_hash_aggregated(ledger):
    """The first aggregation, on ledger rows, must not sort them."""
    nodes = tree(plans.lifecycle_audit(ledger)).splitlines()
    aggregates = [line for line in nodes if "Aggregate" in line]
    assert "HashAggregate" in aggregates[-1] and "HashAggregate" in aggregates[-2]


@pytest.mark.parametrize("name", ["kpi_board", "breakdown_iopr", "spillover_alerts", "monthly_curve", "project_progress"])
def test_hash_aggregation_only(spark, name):
    assert "SortAggregate" not in tree(entry_points.ledger_queries()[name](spark, SF_DIR))


@contextlib.contextmanager
def conf(spark, **values):
    """Session settings for the duration of a block; underscores stand for dots."""
    names = {f"spark.sql.{name.replace('_', '.')}": value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def method_sizes(spark, frame_of) -> list[int]:
    """Largest generated method of each fused stage, all stages fused, planned without AQE."""
    text = io.StringIO()
    with conf(spark, adaptive_enabled="false", codegen_hugeMethodLimit="65535"), contextlib.redirect_stdout(text):
        frame_of().explain("codegen")
    return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]


@pytest.mark.parametrize("name", sorted(entry_points.ledger_queries()))
def test_generated_methods_are_small_enough_to_compile(spark, name):
    """The JVM interprets methods beyond 8000 bytes, whatever the session says about fusing them."""
    sizes = method_sizes(spark, lambda: entry_points.ledger_queries()[name](spark, SF_DIR))
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("query", [plans.kpi_board, plans.project_progress, plans.lifecycle_audit, plans.monthly_cube])
def test_methods_with_coercion_are_small_enough_to_compile(spark, query):
    sizes = method_sizes(spark, lambda: query(normalise(ledgers.yearly_scan(spark, SF_DIR))))
    assert sizes and max(sizes) <= 8000
    assert max(method_sizes(spark, lambda: normalise(star_ledger(spark, SF_DIR)))) <= 8000


def test_rebalanced_write_deals_out_ranges(spark, tmp_path):
    """Files of a year and class hold CUIs that don't overlap, and a hot CUI is spread over several."""
    raw = ledgers.yearly_scan(spark, SF_DIR)
    hot = F.when(F.col(s.GOAL_CODE) < "0014", s.CATCH_ALL_CUI).otherwise(F.col(s.CUI))
    one = raw.withColumns({s.CUI: hot, s.EXPENSE_CLASS: F.lit("6"), s.YEAR: F.lit(2000)})
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = ledger_ingest(one, str(tmp_path / "table"), rebalance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("lines"), F.min(s.CUI).alias("low"), F.max(s.CUI).alias("high")
    )
    ranges = sorted((r.low, r.high, r.lines) for r in files.collect() if r.low is not None)
    assert len(ranges) >= 6
    assert all(one[1] <= other[0] for one, other in zip(ranges, ranges[1:]))
    assert sum(r[0] <= s.CATCH_ALL_CUI <= r[1] for r in ranges) >= 2
    assert max(r[2] for r in ranges) < 0.3 * table.count()
