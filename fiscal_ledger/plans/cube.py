"""The monthly cube: the ledger summed over everything the queries never tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.sources.typed import CLUSTERING, open_ledger, write_by_year

# Below the cube's folder; Spark's readers pass over names that begin with an underscore.
_STAGED = "_staged"
_MERGED = "_merged"

# Lines that a task turns into cells at most: a cell takes some 600 bytes of its hash map, and cells may be as many as lines.
LINES_PER_TASK = 500_000


def monthly_cube(ledger: DataFrame) -> DataFrame:
    """The seven measures by year, month and every code and name of the contract.

    It has the ledger's columns, and each query gives the same answer on it
    as on the ledger. Build it where ledger lines repeat these columns; a
    published ledger is finer than the contract in several more codes.
    """
    return ledger.groupBy(*s.DIMENSIONS).agg(*[F.sum(m).alias(m) for m in s.MEASURES]).select(*s.COLUMNS)


def _cells(ledger: DataFrame) -> DataFrame:
    """The monthly cube of a ledger, each cell in the range of the row order that its file holds.

    Lines are dealt out in ranges of the cube's own dimensions before they are summed, so a single shuffle serves the sums and the
    files. Summing first would do so in the tasks that scan, and one that reads a well-compressed file has more cells than its memory holds. The
    number of ranges follows the number of lines. Dimensions behind the row order spread a CUI and goal with very many lines.
    """
    tasks = max(ledger.sparkSession.sparkContext.defaultParallelism, -(-ledger.count() // LINES_PER_TASK))
    return monthly_cube(ledger.repartitionByRange(tasks, *CLUSTERING, s.GOAL_CODE, s.UNIT_CODE, s.MONTH, s.FUNDING_CODE))


def write_cube(ledger: DataFrame, path: str) -> DataFrame:
    """Write the cube partitioned by year and return the written table."""
    write_by_year(_cells(ledger.select(*s.COLUMNS)), path, rebalance=False)
    return open_ledger(ledger.sparkSession, path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cube_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch): the deltas that have been merged into a cube."""
    log = f"{path}/{_MERGED}"
    return spark.read.schema("batch string").parquet(log) if _exists(spark, log) else spark.createDataFrame([], "batch string")


def merge_into_cube(late: DataFrame, path: str, batch: str) -> DataFrame:
    """Add late ledger lines to a written cube; only the years they belong to are rewritten.

    Sums are additive, so a year's new cube is the sum of its old one and of the cube of the late lines: the ledger
    itself is not read again. ``late`` has the typed contract columns (see ``normalise``); corrections are lines with negative amounts.

    A batch is added once, whatever happens on the way: the merged years are first staged under its name and marked complete,
    then put in place, then the batch is entered in the cube's log. A second call finds the log entry and does
    nothing; a call after a failure finds the staged years and only puts them in place. Batches of one cube must not run at the same time.
    """
    spark = late.sparkSession
    if not cube_batches(spark, path).where(F.col("batch") == F.lit(batch)).isEmpty():
        return open_ledger(spark, path)
    staged = f"{path}/{_STAGED}/batch={batch}"
    entry = spark.createDataFrame([(batch,)], "batch string").coalesce(1)
    complete = f"{path}/{_STAGED}/complete={batch}"
    if not _exists(spark, f"{complete}/_SUCCESS"):
        late = late.select(*s.COLUMNS)
        # One row per fiscal year, and null for lines without one.
        years = [row[0] for row in late.select(s.YEAR).distinct().collect()]
        in_years = F.col(s.YEAR).isin([y for y in years if y is not None])
        if None in years:
            in_years = F.coalesce(in_years, F.lit(True))
        touched = open_ledger(spark, path).where(in_years)
        write_by_year(_cells(touched.unionByName(late)), staged, rebalance=False)
        entry.write.mode("overwrite").parquet(complete)
    write_by_year(open_ledger(spark, staged), path, rebalance=False)
    entry.write.mode("append").parquet(f"{path}/{_MERGED}")
    return open_ledger(spark, path)
