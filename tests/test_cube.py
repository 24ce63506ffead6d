"""Late lines merged into the cube, and queries routed to it."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from checks import ledgers
from fiscal_ledger import LedgerFilter, ledger_ingest, plans
from fiscal_ledger import schema as s
from fiscal_ledger.plans import LedgerTables
from tests.conftest import SF_DIR
from tests.micro import ledger, rows
from tests.test_plans import plan


def same(one, other):
    assert one.schema == other.schema
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).glob("ANO_EJE=*/*.parquet")}


def test_merged_cube_is_the_rebuilt_one(spark):
    same(ledgers.merged_cube(spark, SF_DIR), ledgers.cube_table(spark, SF_DIR))


@pytest.fixture
def cube(spark, tmp_path):
    path = str(tmp_path / "cube")
    first = ledger(spark, {s.YEAR: 2024, s.PIM: 1}, {s.YEAR: 2025, s.PIM: 2}, {s.YEAR: 2025, s.PIM: 3}, {s.YEAR: None, s.PIM: 4}, {s.YEAR: 2025, s.PIM: None})
    plans.write_cube(first, path)
    return path


def test_other_years_are_untouched(spark, cube):
    before = files(cube)
    late = ledger(spark, {s.YEAR: 2025, s.PIM: 10}, {s.YEAR: 2025, s.PIM: 100, s.CUI: "new"})
    merged = plans.merge_into_cube(late, cube, "b1")
    after = files(cube)
    kept = {f: t for f, t in before.items() if "2025" not in f}
    assert kept and kept.items() <= after.items()
    assert not {f for f in before if "2025" in f} & after.keys()
    totals = merged.groupBy(s.YEAR, s.CUI).agg(F.sum(s.PIM), F.count("*")).orderBy(s.YEAR, s.CUI)
    assert rows(totals) == [(None, "2000001", 4.0, 1), (2024, "2000001", 1.0, 1), (2025, "2000001", 15.0, 1), (2025, "new", 100.0, 1)]


def test_a_batch_is_added_once(spark, cube):
    late = ledger(spark, {s.YEAR: 2025, s.PIM: 10}, {s.YEAR: None, s.PIM: 1}, {s.YEAR: 2030, s.PIM: 7})
    for _ in range(3):
        merged = plans.merge_into_cube(late, cube, "b1")
    assert rows(merged.groupBy(s.YEAR).agg(F.sum(s.PIM)).orderBy(s.YEAR)) == [(None, 5.0), (2024, 1.0), (2025, 15.0), (2030, 7.0)]
    assert rows(plans.cube_batches(spark, cube)) == [("b1",)]
    again = plans.merge_into_cube(late, cube, "b2")
    assert rows(again.groupBy(s.YEAR).agg(F.sum(s.PIM)).orderBy(s.YEAR)) == [(None, 6.0), (2024, 1.0), (2025, 25.0), (2030, 14.0)]


@pytest.mark.parametrize("fails_at", ["place", "log"])
def test_a_failure_on_the_way_adds_nothing_twice(spark, cube, monkeypatch, fails_at):
    from fiscal_ledger.plans import cube as module

    late = ledger(spark, {s.YEAR: 2025, s.PIM: 10})
    write, opened = module.write_by_year, module.open_ledger
    calls = []

    def failing(frame, path, rebalance):
        calls.append(path)
        if len(calls) == 2 and fails_at == "place":
            raise RuntimeError("lost")
        write(frame, path, rebalance)
        if len(calls) == 2 and fails_at == "log":
            raise RuntimeError("lost")

    monkeypatch.setattr(module, "write_by_year", failing)
    with pytest.raises(RuntimeError):
        plans.merge_into_cube(late, cube, "b1")
    merged = plans.merge_into_cube(late, cube, "b1")
    assert rows(merged.groupBy(s.YEAR).agg(F.sum(s.PIM)).orderBy(s.YEAR)) == [(None, 4.0), (2024, 1.0), (2025, 15.0)]
    assert opened is module.open_ledger


def reads(frame, table) -> bool:
    location = table.inputFiles()[0].split("/ANO_EJE=")[0].removeprefix("file:").lstrip("/")
    return location in plan(frame)


def test_routing(spark):
    tables = ledgers.tables(spark, SF_DIR)
    where = LedgerFilter(year=2000, level="ASIA")
    for query, arguments, chosen in (
        (plans.kpi_board, (), where),
        (plans.project_sheet, ("2000015",), None),
        (plans.unit_ranking, (), F.col(s.SECTOR).like("NATION%") & (F.col(s.MONTH) < 7)),
    ):
        assert tables.table_for(query, chosen) is tables.cube
        routed = tables.run(query, *arguments, where=chosen)
        assert reads(routed, tables.cube) and not reads(routed, tables.ledger)
        same(routed, query(tables.ledger, *arguments, where=chosen))
    # An amount selects lines, which the cube has summed.
    assert tables.table_for(plans.unit_ranking, F.col(s.PIM) > 1000) is tables.ledger
    assert LedgerTables(tables.ledger).table_for(plans.kpi_board) is tables.ledger


def test_a_cube_that_lacks_a_year_is_not_used(spark, tmp_path):
    table = ledger_ingest(ledger(spark, {s.YEAR: 2024}, {s.YEAR: 2025}), str(tmp_path / "ledger"))
    cube = plans.write_cube(table.where(F.col(s.YEAR) == 2024), str(tmp_path / "cube"))
    assert LedgerTables(table, cube).table_for(plans.kpi_board) is table
    plans.merge_into_cube(table.where(F.col(s.YEAR) == 2025), str(tmp_path / "cube"), "2025")
    assert LedgerTables(table, plans.write_cube(table, str(tmp_path / "whole"))).table_for(plans.kpi_board) is not table


def test_a_page_reads_the_cube(spark):
    tables = ledgers.tables(spark, SF_DIR)
    page = tables.page(LedgerFilter(year=2000, level="ASIA"), cui="2000015")
    assert len(page) == 14
    for name, frame in page.items():
        assert reads(frame, tables.cube) and not reads(frame, tables.ledger), name
    on_ledger = LedgerTables(tables.ledger).page(LedgerFilter(year=2000, level="ASIA"), cui="2000015")
    for name, frame in page.items():
        assert sorted(map(repr, frame.collect())) == sorted(map(repr, on_ledger[name].collect())), name


def test_a_cube_is_written_with_one_shuffle(spark, monkeypatch):
    """Lines reach the tasks that sum and write them in ranges, as many as the lines need, and not as sums per scanning task."""
    from fiscal_ledger.plans import cube as module

    monkeypatch.setattr(module, "LINES_PER_TASK", 1000)
    table = ledgers.typed_ledger(spark, SF_DIR)
    cells = module._cells(table)
    initial = cells._jdf.queryExecution().sparkPlan().toString() + plan(cells)
    assert "Exchange rangepartitioning" in initial and "Exchange hashpartitioning" not in initial
    assert cells.rdd.getNumPartitions() >= table.count() // 1000
    same(cells, plans.monthly_cube(table))
