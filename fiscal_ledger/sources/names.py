"""Tables beside the ledger: an order-keeping dictionary of names, a trigram index of projects.

Both are written once per state of the ledger and read by many queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger import schema as s

NAMES_SCHEMA = "name string, number bigint"
TRIGRAMS_SCHEMA = "trigram string, field string, cui string, project string"
ENTRIES_SCHEMA = "cui string, project string"
GRAM = 3


def write_names(ledger: DataFrame, column: str, path: str) -> DataFrame:
    """(name, number) of the distinct names in a column; numbers are in the order of the names.

    Spark keeps no text maximum in a hash-aggregation buffer, but it keeps a number's; with the numbers in order
    the greatest one is that of the greatest name. Names are sorted by ranges, and ``monotonically_increasing_id``
    grows from range to range, so no task sees all of them. The numbers are only good together with
    this table, so it is written before it is used.
    """
    names = ledger.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().orderBy("name")
    names.withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return open_names(ledger.sparkSession, path)


def open_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAMES_SCHEMA).parquet(path)


def folded(text: Column) -> Column:
    """Text without case, as patterns that ignore it compare: lowered, then raised, which also joins the two small sigmas."""
    return F.upper(F.lower(F.translate(text, "İ", "i")))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a folded text; none where it is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    runs = F.transform(places, lambda at: F.substr(text, at, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_search_index(ledger: DataFrame, path: str) -> None:
    """Write the distinct projects (CUI, name) and the trigrams of both their fields.

    Trigrams are dealt into sorted ranges, so a lookup of a few reads the row groups with these alone. The name at the end of the range columns spreads
    a trigram that most names have. Projects without a name are never found, so they are not indexed.
    """
    entries = (
        ledger.where(F.col(s.PROJECT).isNotNull())
        .select(F.col(s.CUI).cast("string").alias("cui"), F.col(s.PROJECT).alias("project"))
        .distinct()
    )
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    entries = ledger.sparkSession.read.schema(ENTRIES_SCHEMA).parquet(f"{path}/entries")
    fields = F.explode(
        F.array(*[F.struct(F.lit(name).alias("field"), trigrams(folded(F.col(name))).alias("grams")) for name in ("project", "cui")])
    )
    grams = entries.select(fields.alias("f"), "cui", "project").select(
        F.explode("f.grams").alias("trigram"), F.col("f.field").alias("field"), "cui", "project"
    )
    order = ("trigram", "project", "cui")
    grams.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/trigrams")
