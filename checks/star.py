"""A budget ledger derived from star-schema order tables.

The published ledgers are not part of this repository, so tests, checks and
benchmarks derive one: a lineitem row becomes a budget line, its part the
project, its supplier the executing unit, its ship year the fiscal year.
Amounts and codes are text with unreadable values mixed in, as in the
published files; amounts are whole numbers, so that sums are exact in any order.
Each order line makes two budget lines of the same dimensions: one has the opening
budget, the other the later amounts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger import schema as s


def _text(column: Column) -> Column:
    return column.cast("string")


def _whole_text(column: Column) -> Column:
    return column.cast("bigint").cast("string")


# Order lines a task widens at most. Two budget lines each of some 400 bytes are sorted in its memory when they are written.
ORDER_LINES_PER_TASK = 250_000

# How the order lines are dealt out before they become budget lines, given the number of tasks.
Deal = Callable[[DataFrame, int], DataFrame]


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")


def _with_sectors(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Two small tables, joined one by one: the size of their join is estimated as the product of theirs, which may shuffle the lines."""
    nation = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    region = spark.read.parquet(f"{folder}/region.parquet").select("r_regionkey", "r_name")
    return rows.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_partkey",
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.year("l_shipdate").alias(s.YEAR),
        F.month("l_shipdate").alias("month"),
        F.floor("l_extendedprice").alias("price"),
        F.floor("l_quantity").alias("quantity"),
    )


def _cui() -> Column:
    partkey = F.col("l_partkey")
    return (
        F.when(partkey % 50 == 0, s.CATCH_ALL_CUI)
        .when(partkey % 211 == 7, F.lit(None).cast("string"))
        .otherwise(_text(partkey + 2000000))
    )


def _goal_code() -> Column:
    return F.lpad(_text(F.col("l_orderkey") % 40), 4, "0")


def by_row_order(rows: DataFrame, tasks: int) -> DataFrame:
    """Ranges of the typed table's row order, with the goal to spread a CUI that has very many lines."""
    return rows.repartitionByRange(tasks, F.col(s.YEAR), _expense_class(), _cui(), _goal_code())


def by_year(rows: DataFrame, tasks: int) -> DataFrame:
    """Ranges of years; the keys behind the year spread one that has very many lines."""
    return rows.repartitionByRange(tasks, s.YEAR, "l_partkey", "l_orderkey")


def by_goal(rows: DataFrame, tasks: int) -> DataFrame:
    """Ranges of goals; the keys behind the goal spread one that has very many lines."""
    return rows.repartitionByRange(tasks, _goal_code(), F.col("l_partkey"), F.col("l_orderkey"))


def in_no_order(rows: DataFrame, tasks: int) -> DataFrame:
    """By a hash of the order line: every task has lines of all years and projects."""
    return rows.repartition(tasks, "l_orderkey", "l_linenumber")


def _expense_class() -> Column:
    size_class = F.col("p_size") % 3
    return F.when(size_class == 0, "6").when(size_class == 1, "5").otherwise("7")


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _order_lines(spark, folder)
        .join(_projects(spark, folder), F.col("l_partkey") == F.col("p_partkey"))
        .join(_units(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _budget_lines(rows: DataFrame) -> DataFrame:
    line, order, part, stage = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_returnflag")
    price, quantity, size_class, supplier = F.col("price"), F.col("quantity"), F.col("p_size") % 3, F.col("s_suppkey")

    def later(amount: Column) -> Column:
        return F.when(F.col("half") == 1, amount)

    programme = F.when(F.col("p_brand") == "Brand#1", "9001").when(F.col("p_brand") == "Brand#2", "9002")
    programme = programme.when(F.col("p_brand") == "Brand#3", F.lit(None).cast("string"))
    funding = F.when(line == 1, "00").when(line == 2, "09").when(line == 3, "07")
    funding = funding.when(line == 4, "08").when(line == 5, "13").when(line == 6, "18").otherwise("19")
    return (
        rows.withColumns(
            {
                "pia": F.when(part % 7 == 0, F.lit(0)).otherwise(price),
                "pim": F.when(part % 11 == 0, F.lit(0)).otherwise(price + 500 * quantity),
            }
        )
        .withColumn("cert", F.when(part % 13 == 0, F.lit(0)).otherwise(F.floor(F.col("pim") * 9 / 10)))
        .withColumn(
            "dev",
            F.when(stage == "A", F.floor(F.col("cert") * 7 / 10))
            .when(stage == "N", F.floor(F.col("cert") * 4 / 10))
            .otherwise(F.lit(0)),
        )
        .withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.col(s.YEAR),
            F.when(order % 97 == 0, "S/M").otherwise(_text(F.col("month"))).alias(s.MONTH),
            F.col("r_name").alias(s.LEVEL),
            F.col("n_name").alias(s.SECTOR),
            F.concat(F.lit("PLIEGO "), _text(F.col("s_nationkey")), F.lit("/"), _text(supplier % 3)).alias(s.ENTITY),
            F.lpad(_text(supplier), 6, "0").alias(s.UNIT_CODE),
            F.col("s_name").alias(s.UNIT),
            programme.otherwise(F.lpad(F.expr("substring(p_brand, 7)"), 4, "0")).alias(s.PROGRAMME),
            _cui().alias(s.CUI),
            F.when(part % 37 != 3, F.col("p_name")).alias(s.PROJECT),
            F.col("p_type").alias(s.FUNCTION),
            funding.alias(s.FUNDING_CODE),
            F.when(line != 5, F.concat(F.lit("RUBRO "), _text(line))).alias(s.FUNDING),
            _expense_class().alias(s.EXPENSE_CLASS),
            F.when(size_class == 0, "GASTO DE CAPITAL")
            .when(size_class == 1, "GASTO CORRIENTE")
            .otherwise("SERVICIO DE LA DEUDA")
            .alias(s.EXPENSE_CLASS_NAME),
            _goal_code().alias(s.GOAL_CODE),
            F.concat(F.lit("META "), _text(order % 40)).alias(s.GOAL),
            F.when(F.col("half") == 0, _whole_text(F.col("pia"))).alias(s.PIA),
            later(F.when(order % 101 == 0, "N/D").otherwise(_whole_text(F.col("pim")))).alias(s.PIM),
            later(_whole_text(F.col("cert"))).alias(s.CERTIFIED),
            later(_whole_text(F.floor(F.col("cert") * 8 / 10))).alias(s.COMMITTED_ANNUAL),
            later(_whole_text(F.floor(F.col("cert") * 6 / 10))).alias(s.COMMITTED_MONTHLY),
            later(_whole_text(F.col("dev"))).alias(s.ACCRUED),
            later(F.when(order % 103 == 0, "").otherwise(_whole_text(F.floor(F.col("dev") * 95 / 100)))).alias(s.PAID),
        )
        .select(*s.COLUMNS)
    )


def star_ledger(spark: SparkSession, folder: str, deal: Deal | None = None) -> DataFrame:
    """The raw ledger of the star-schema tables in a folder.

    Only the tables' own columns pass the joins, one row per order line; texts are made and lines are doubled behind them, within
    the tasks. No side is broadcast by hint: suppliers and parts grow with
    the data. Each is joined on its own and as it is read, so that Spark knows its size when it
    chooses. Where Spark sorts and merges, AQE splits a part or
    supplier that holds a large share of the lines.

    ``deal`` shuffles the narrow rows, for writers that need an order of tasks. It is told how many tasks keep each small: Spark
    sizes partitions by their compressed bytes, and these rows become ten times as wide.
    """
    rows = _joined(spark, folder)
    if deal is not None:
        lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()  # from the footers
        rows = deal(rows, max(spark.sparkContext.defaultParallelism, -(-lines // ORDER_LINES_PER_TASK)))
    # Sectors are few: they are joined behind the shuffle, which then has no need to carry their names.
    return _budget_lines(_with_sectors(spark, folder, rows))
