"""The ledgers the registered queries run on, derived from the star-schema tables by Spark.

Each is written once per application, into a new folder of the session's
shared folder, and read by all queries after that: many queries then share one
pass over the joins and the coercion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.star import by_goal, by_row_order, by_year, in_no_order, star_ledger
from fiscal_ledger import schema as s
from fiscal_ledger.plans import LedgerTables, merge_into_cube, write_cube
from fiscal_ledger.settings import new_table_path
from fiscal_ledger.sources import ledger_ingest, scan_files, write_names, write_search_index

_tables: dict[tuple[str, str, str], DataFrame] = {}
_indexes: dict[tuple[str, str], str] = {}


def _once(spark: SparkSession, folder: str, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """A table of this application, written on first use."""
    known = (spark.sparkContext.applicationId, folder, name)
    if known not in _tables:
        _tables[known] = write(new_table_path(spark, name))
    return _tables[known]


def typed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as a typed table partitioned by year."""
    return _once(
        spark,
        folder,
        "typed",
        lambda path: ledger_ingest(star_ledger(spark, folder, by_row_order), path),
    )


def cube_table(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly cube of the ledger as a table."""
    ledger = typed_ledger(spark, folder)
    return _once(spark, folder, "cube", lambda path: write_cube(ledger, path))


def is_late() -> Column:
    """The lines of the cube's later batch: one year's December and what has no month."""
    return (F.col(s.YEAR) == 2000) & F.coalesce(F.col(s.MONTH) == 12, F.lit(True))


def merged_cube(spark: SparkSession, folder: str) -> DataFrame:
    """A cube written without the late lines of a year, which are then merged into it."""
    ledger = typed_ledger(spark, folder)

    def write(path: str) -> DataFrame:
        write_cube(ledger.where(~F.coalesce(is_late(), F.lit(False))), path)
        return merge_into_cube(ledger.where(is_late()), path, "late-2000")

    return _once(spark, folder, "merged-cube", write)


def tables(spark: SparkSession, folder: str) -> LedgerTables:
    """The ledger with the merged cube."""
    return LedgerTables(typed_ledger(spark, folder), merged_cube(spark, folder))


def unsorted_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The typed ledger with its rows in the order they come, in small row groups."""
    return _once(
        spark,
        folder,
        "unsorted",
        lambda path: ledger_ingest(star_ledger(spark, folder, in_no_order), path, sort=False, row_group_bytes=256 << 10),
    )


def _children(spark: SparkSession, path: str) -> list[str]:
    """The sub-folders of a folder that Spark has written by partition."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f"{path}/{file.getPath().getName()}" for file in files if "=" in file.getPath().getName())


def many_files_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The raw ledger read back from a folder per goal, in three layouts: text, other types and an extra column, lower-case names."""
    raw = star_ledger(spark, folder, by_goal)

    def write(path: str) -> DataFrame:
        shape = F.col(s.GOAL_CODE).cast("int") % 3
        typed = {s.YEAR: F.col(s.YEAR).cast("bigint"), s.EXPENSE_CLASS: F.col(s.EXPENSE_CLASS).cast("int"), "EXTRA": F.lit("x")}
        frames = [raw.where(shape == 0), raw.where(shape == 1).withColumns(typed), raw.where(shape == 2).toDF(*(c.lower() for c in s.COLUMNS))]
        paths = []
        for number, frame in enumerate(frames):
            in_folders = frame.withColumn("goal_folder", F.col(s.GOAL_CODE))
            in_folders.write.partitionBy("goal_folder").parquet(f"{path}/{number}")
            paths += _children(spark, f"{path}/{number}")
        return scan_files(spark, paths)

    return _once(spark, folder, "many-files", write)


def _write_yearly_files(raw: DataFrame, path: str) -> DataFrame:
    # The copy of the year names the folders and leaves the column in the files.
    dated = raw.withColumn("file_year", F.col(s.YEAR))
    dated.write.partitionBy("file_year").parquet(path)
    spark = raw.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [file.getPath().getName() for file in files]  # lines without a year have a folder of their own
    return scan_files(spark, [f"{path}/{name}" for name in sorted(names, reverse=True) if name.startswith("file_year=")])


def yearly_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The raw ledger read back from one Parquet folder per fiscal year, latest year first."""
    raw = star_ledger(spark, folder, by_year)
    return _once(spark, folder, "yearly", lambda path: _write_yearly_files(raw, path))


def nan_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The typed ledger with amounts that are no numbers: one project in May."""
    odd = (F.col(s.CUI) == "2000015") & (F.col(s.MONTH) == 5)
    nan = F.lit(float("nan"))
    ledger = typed_ledger(spark, folder)
    return ledger.withColumns({c: F.when(odd, nan).otherwise(F.col(c)) for c in (s.PIA, s.PIM, s.ACCRUED)})


def fraction_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The typed ledger with amounts that have endless binary fractions."""
    ledger = typed_ledger(spark, folder)
    return ledger.withColumns({c: F.col(c) / F.lit(7.0) for c in s.MEASURES})


def unit_names(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's dictionary of executing units."""
    ledger = typed_ledger(spark, folder)
    return _once(spark, folder, "unit-names", lambda path: write_names(ledger, s.UNIT, path))


def search_index(spark: SparkSession, folder: str) -> str:
    """Where the ledger's search index is, written on first use."""
    known = (spark.sparkContext.applicationId, folder)
    if known not in _indexes:
        path = new_table_path(spark, "search-index")
        write_search_index(typed_ledger(spark, folder), path)
        _indexes[known] = path
    return _indexes[known]
