"""The dictionary of units behind the risk ranking, the trigram index behind the search."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import ledgers
from fiscal_ledger import LedgerFilter, plans
from fiscal_ledger import schema as s
from fiscal_ledger.sources import write_names, write_search_index
from tests.conftest import SF_DIR
from tests.micro import ledger, rows
from tests.test_plans import tree


def test_numbers_keep_the_order_of_names(spark):
    names = ledgers.unit_names(spark, SF_DIR).collect()
    assert len({r.number for r in names}) == len(names) == 100
    assert [r.name for r in sorted(names, key=lambda r: r.number)] == sorted(r.name for r in names)


@pytest.mark.parametrize("where", [None, LedgerFilter(year=2000, level="ASIA")])
def test_ranking_without_sorting_lines(spark, where):
    table, names = ledgers.typed_ledger(spark, SF_DIR), ledgers.unit_names(spark, SF_DIR)
    coded = plans.risk_ranking(table, where, unit_names=names)
    assert rows(coded) == rows(plans.risk_ranking(table, where))
    assert "SortAggregate" not in tree(coded) and "SortAggregate" in tree(plans.risk_ranking(table, where))
    assert "TakeOrderedAndProject" in tree(coded)


def test_names_beyond_ascii_nulls_and_strangers(spark, tmp_path):
    frame = ledger(
        spark,
        *[{s.CUI: "1", s.UNIT: unit, s.PIM: 5} for unit in ("b", "B", "é", "\U0001f642", "￿", None)],
        {s.CUI: "2", s.UNIT: None, s.PIM: 5},
        {s.CUI: "3", s.UNIT: "b", s.PIM: 5},
    )
    names = write_names(frame, s.UNIT, str(tmp_path / "names"))
    assert rows(plans.risk_ranking(frame, unit_names=names)) == rows(plans.risk_ranking(frame))
    with pytest.raises(Exception, match="not in the dictionary of units: b"):
        plans.risk_ranking(frame, unit_names=names.where("name <> 'b'")).collect()


SEARCHES = ["ring", "RING", "ri", "", None, "2000015", "000", "a.*e", "(sky|sea)", "no such project", " ", "[", "x" * 40, "3999999"]


@pytest.mark.parametrize("text", [t for t in SEARCHES if t != "["])
def test_same_rows_as_the_pattern(spark, text):
    table, index = ledgers.typed_ledger(spark, SF_DIR), ledgers.search_index(spark, SF_DIR)
    assert rows(plans.indexed_search(table, index, text)) == rows(plans.project_search(table, text))


def test_candidates_are_few(spark, tmp_path):
    """Of 6,000 projects the index proposes those with the text's trigrams; a pattern leaves all."""
    words = ["puente", "camino", "escuela", "hospital", "canal", "parque", "mercado", "represa"]
    number = F.col("id")
    name = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), (F.floor(number / 8**i) % 8 + 1).cast("int")) for i in range(4)], number.cast("string"))
    projects = spark.range(6000).select(F.concat(F.lit("C"), number).alias(s.CUI), name.alias(s.PROJECT))
    index = str(tmp_path / "index")
    write_search_index(projects, index)
    for text, most in (("hospital canal parque", 200), ("C4711", 20), ("Escuela", 4000)):
        candidates = plans.search_candidates(spark, index, text)
        matching = candidates.where(F.lower("project").contains(text.lower()) | F.col("cui").contains(text)).count()
        whole = projects.where(F.lower(s.PROJECT).contains(text.lower()) | F.col(s.CUI).contains(text)).count()
        assert matching == whole > 0
        assert candidates.count() <= most
    assert plans.search_candidates(spark, index, "hosp.tal").count() == 6000


def test_case_as_patterns_see_it(spark, tmp_path):
    names = ["STRASSE straße", "ΟΔΟΣ οδός", "Kelvin K", "İstanbul ışık", "ſoft long s", "O'Higgins", None, "ab"]
    frame = ledger(spark, *[{s.CUI: str(i), s.PROJECT: name, s.PIM: 1} for i, name in enumerate(names)], {s.CUI: None, s.PROJECT: "no code", s.PIM: 1})
    index = str(tmp_path / "index")
    write_search_index(frame, index)
    for text in ("straße", "οδος", "ΟΔΌΣ", "kelvin k", "istanbul", "IŞIK", "soft", "o'higgins", "code", "abc", "ab", "7"):
        assert rows(plans.indexed_search(frame, index, text)) == rows(plans.project_search(frame, text)), text
