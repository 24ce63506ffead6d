"""Point lookups by CUI read only the row groups that hold it, also in a table in no order."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fiscal_ledger import ledger_ingest, plans
from fiscal_ledger import schema as s
from tests.micro import raw_ledger

ROWS = 60_000


@pytest.fixture(scope="module")
def unsorted(spark, tmp_path_factory):
    """Every CUI is unique but one, so no dictionary fits; rows are in hash order; many small row groups."""
    path = str(tmp_path_factory.mktemp("lookup"))
    number = F.col("id")
    cui = F.when(number % 20_000 == 7, "2000015").otherwise(F.sha2(number.cast("string"), 256))
    constant = raw_ledger(spark, {}).drop(s.YEAR, s.CUI, s.PIM)
    raw = spark.range(ROWS).select(F.lit(2025).alias(s.YEAR), cui.alias(s.CUI), number.cast("string").alias(s.PIM)).crossJoin(constant)
    return ledger_ingest(raw.repartition(2, F.xxhash64(s.CUI, s.PIM)), path, sort=False, row_group_bytes=128 << 10), path


def rows_read(frame) -> tuple[int, int]:
    """Rows the scan handed on, and rows of the result."""
    query = frame._jdf.queryExecution()
    found = query.executedPlan().executeCollect()
    scan = query.executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), len(found)


def groups(path):
    """CUIs of each row group of the written files."""
    import pathlib

    for file in pathlib.Path(path).rglob("*.parquet"):
        opened = pq.ParquetFile(file)
        for number in range(opened.num_row_groups):
            yield opened.read_row_group(number, columns=[s.CUI]).column(0).to_pylist()


def test_lookup_reads_only_groups_with_the_cui(spark, unsorted):
    table, path = unsorted
    held = list(groups(path))
    assert len(held) > 20 and sum(map(len, held)) == ROWS
    assert sum(min(g) < "2000015" < max(g) for g in held) == len(held)  # minimum and maximum rule no group out
    expected = sum(len(g) for g in held if "2000015" in g)
    read, found = rows_read(table.where(F.col(s.CUI) == "2000015").select(s.PIM))
    assert found == 3 and read <= expected < ROWS / 5
    assert rows_read(table.where(F.col(s.CUI) == "2000016").select(s.PIM)) == (0, 0)


def test_queries_use_it(spark, unsorted):
    table, _ = unsorted
    for query in (plans.project_sheet, plans.project_history):
        row = query(table, "2000015").first()
        assert row.pim == 7 + 20_007 + 40_007
    assert plans.project_sheet(table, "2000016").isEmpty()


def test_no_dictionary_does_the_work(unsorted):
    import pathlib

    for file in pathlib.Path(unsorted[1]).rglob("*.parquet"):
        metadata = pq.read_metadata(file)
        at = [metadata.schema.column(i).name for i in range(metadata.num_columns)].index(s.CUI)
        assert all("RLE_DICTIONARY" not in metadata.row_group(g).column(at).encodings for g in range(metadata.num_row_groups - 1))
