"""All selectors from one scan, and running sums of many entities."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import ledgers
from fiscal_ledger import LedgerFilter, plans
from fiscal_ledger import schema as s
from tests.conftest import SF_DIR
from tests.micro import ledger, rows
from tests.test_plans import shuffles, tree

CHOICES = [
    LedgerFilter(),
    LedgerFilter(year=2000),
    LedgerFilter(year=2000, level="ASIA", sector="NATION_7", entity="PLIEGO 7/0"),
    LedgerFilter(level="Todos", sector="NATION_7"),
    LedgerFilter(year=1900, level="nowhere"),
]


@pytest.mark.parametrize("chosen", CHOICES)
def test_lists_equal_their_own_queries(spark, chosen):
    table = ledgers.typed_ledger(spark, SF_DIR)
    found = plans.cascade_options(table, chosen)
    assert tree(found).count("Scan parquet") == 1
    lists = {name: [r.option for r in found.collect() if r.selector == name] for name in ("year", "level", "sector", "entity", "unit")}
    year = LedgerFilter(year=chosen.year)
    level, sector = LedgerFilter(chosen.year, chosen.level), LedgerFilter(chosen.year, chosen.level, chosen.sector)
    entity = LedgerFilter(chosen.year, chosen.level, chosen.sector, chosen.entity)
    assert lists["year"] == [str(r[0]) for r in plans.years_available(table).collect()]
    for name, column, where in (("level", s.LEVEL, year), ("sector", s.SECTOR, level), ("entity", s.ENTITY, sector)):
        assert lists[name] == [r[0] for r in plans.filter_options(table, column, where).collect()]
    assert lists["unit"] == [r[0] for r in plans.executing_units(table, entity).collect()]


def test_options_of_nulls(spark):
    frame = ledger(spark, {s.YEAR: None, s.LEVEL: None, s.UNIT: None}, {s.YEAR: 9, s.LEVEL: "L"}, {s.YEAR: 10, s.LEVEL: "K"})
    assert rows(plans.cascade_options(frame), "selector", "option") == [
        ("year", "10"), ("year", "9"), ("level", "K"), ("level", "L"), ("sector", "EDUCACION"), ("entity", "PLIEGO 1"),
        ("unit", "000001 - "), ("unit", "000001 - UNIDAD 1"),
    ]


def test_running_sums_per_entity(spark):
    frame = ledger(
        spark,
        {s.ENTITY: "A", s.MONTH: "2", s.ACCRUED: 10, s.PIM: 100},
        {s.ENTITY: "A", s.MONTH: "4", s.ACCRUED: None},
        {s.ENTITY: "A", s.MONTH: "5", s.ACCRUED: 3},
        {s.ENTITY: "A", s.MONTH: None, s.ACCRUED: 7},
        {s.ENTITY: None, s.MONTH: "1", s.ACCRUED: 1, s.PIM: 0},
    )
    found = plans.cumulative_by(frame)
    a = [tuple(r) for r in found.where("entity = 'A'").select("month", "accrued", "cumulative_accrued", "pct_accrued", "lines").collect()]
    assert a[:5] == [(1, 0.0, 0.0, 0.0, 0), (2, 10.0, 10.0, 10.0, 1), (3, 0.0, 10.0, 10.0, 0), (4, None, None, None, 1), (5, 3.0, 13.0, 13.0, 1)]
    assert a[11:] == [(12, 0.0, 13.0, 13.0, 0), (None, 7.0, 20.0, 20.0, 1)]
    nobody = rows(found.where("entity IS NULL"), "month", "cumulative_accrued", "pct_accrued")
    assert nobody == [(m, 1.0, 0.0) for m in range(1, 13)]
    assert plans.cumulative_by(frame.limit(0)).isEmpty()


def test_one_entity_is_the_evolution_of_the_whole(spark):
    """Where every month has lines, an entity's sums are those of the single query under its filter."""
    table = ledgers.typed_ledger(spark, SF_DIR)
    columns = ["month", "committed_monthly", "accrued", "cumulative_committed", "cumulative_accrued", "pct_accrued", "month_name"]
    by_sector = plans.cumulative_by(table, (s.SECTOR,))
    for sector in ("NATION_7", "NATION_0"):
        single = plans.cumulative_evolution(table, LedgerFilter(sector=sector))
        assert rows(by_sector.where(F.col("sector") == sector), *columns) == rows(single, *columns)


def test_a_hot_entity_is_summed_before_it_is_shuffled(spark):
    table = ledgers.typed_ledger(spark, SF_DIR)
    hot = table.withColumn(s.ENTITY, F.when(F.col(s.GOAL_CODE) < "0014", "hot").otherwise(F.col(s.ENTITY)))
    assert hot.where(f"{s.ENTITY} = 'hot'").count() * 3 > table.count()
    found = plans.cumulative_by(hot)
    plain = hot.where(f"{s.ENTITY} = 'hot'").groupBy(s.MONTH).agg(F.sum(s.ACCRUED)).collect()
    last = found.where("entity = 'hot'").collect()[-1]
    assert last.cumulative_accrued == sum(r[1] for r in plain)
    nodes = tree(found)
    assert "SortMergeJoin" not in nodes and "BroadcastHashJoin" not in nodes and shuffles(found) <= 6
    assert "Window" in nodes and "SinglePartition" not in nodes
