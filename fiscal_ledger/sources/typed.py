"""The typed ledger table: coerced once, partitioned by fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscal_ledger import schema as s
from fiscal_ledger.sources.files import normalise

# Row order within the files. Row groups then hold few expense classes and a
# narrow range of CUIs each, so their min/max statistics skip most of the data
# for the capital-class filter and for a single project.
CLUSTERING = (s.YEAR, s.EXPENSE_CLASS, s.CUI)


# Point lookups by CUI. A row group's Bloom filter says whether it can hold a CUI at all, also where the rows are in no order and
# every group spans all CUIs. It is sized for this many distinct CUIs in a row group; with more it only lets more groups through.
# (A group whose CUIs fit a dictionary needs none: the reader looks into the dictionary.)
CUIS_PER_ROW_GROUP = 200_000
# A line takes more than these bytes of a row group, so small groups are given filters in proportion.
LEAST_LINE_BYTES = 16


def write_by_year(frame: DataFrame, path: str, rebalance: bool, sort: bool = True, row_group_bytes: int | None = None) -> None:
    """Write a ledger-shaped frame as Parquet partitioned by fiscal year.

    Only the years in the frame are replaced, so one year can be refreshed on
    its own. Tasks that read yearly files hold one year each and need no
    shuffle. A frame whose tasks hold every year (after a join or a group-by)
    would write tasks x years small files; ``rebalance`` deals it out in ranges of
    the row order first. Files then hold ranges of CUIs that don't overlap, so reading
    one project skips most of them. The goal at the end of the range
    columns spreads a CUI with very many lines over several tasks. Finding the ranges
    takes a second pass over the frame, which pays off when the table is read often.

    Without ``sort`` rows stay in the order they come in; lookups by CUI still skip the row groups without it.
    """
    if rebalance:
        frame = frame.repartitionByRange(*CLUSTERING, s.GOAL_CODE)
    if sort:
        frame = frame.sortWithinPartitions(*CLUSTERING)
    cuis = CUIS_PER_ROW_GROUP if row_group_bytes is None else min(CUIS_PER_ROW_GROUP, max(1, row_group_bytes // LEAST_LINE_BYTES))
    writer = (
        frame.write.partitionBy(s.YEAR)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option(f"parquet.bloom.filter.enabled#{s.CUI}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{s.CUI}", str(cuis))
    )
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by ``ledger_ingest`` or ``write_cube``.

    The schema is given, so no file is opened to infer it.
    """
    return spark.read.schema(s.LEDGER_SCHEMA).parquet(path).select(*s.COLUMNS)


def ledger_ingest(
    raw: DataFrame, path: str, rebalance: bool = False, sort: bool = True, row_group_bytes: int | None = None
) -> DataFrame:
    """Coerce a raw ledger, write it as a typed table and return that table.

    Queries on the raw files coerce text again each time and cannot push
    their filters through the casts. On the typed table the year prunes
    partitions and the other filters reach the Parquet reader.
    """
    write_by_year(normalise(raw), path, rebalance, sort, row_group_bytes)
    return open_ledger(raw.sparkSession, path)
