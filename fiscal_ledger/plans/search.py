"""Project search through a trigram index instead of a pattern over every project."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.operators.filters import Where, matches_search
from fiscal_ledger.plans.projects import project_progress
from fiscal_ledger.sources.names import ENTRIES_SCHEMA, GRAM, TRIGRAMS_SCHEMA, folded

# Characters that mean something else than themselves in a pattern.
_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")


def search_candidates(spark: SparkSession, index: str, text: str) -> DataFrame:
    """(cui, project) of the indexed projects that may match a text: all that do, and few others.

    A plain text of three characters or more can only be in a name (or CUI) that has all of its trigrams. Shorter texts and patterns choose
    nothing: all indexed projects are candidates then, still each one once instead of once per ledger line.
    """
    entries = spark.read.schema(ENTRIES_SCHEMA).parquet(f"{index}/entries")
    if len(text) < GRAM or _SPECIAL.search(text):
        return entries
    whole = spark.range(1).select(folded(F.lit(text)).alias("text")).first()[0]
    wanted = sorted({whole[i : i + GRAM] for i in range(len(whole) - GRAM + 1)})
    table = spark.read.schema(TRIGRAMS_SCHEMA).parquet(f"{index}/trigrams")
    found = table.where(F.col("trigram").isin(wanted)).groupBy("field", "cui", "project").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(wanted)).select("cui", "project").distinct()


def indexed_search(ledger: DataFrame, index: str, text: str | None, where: Where = None) -> DataFrame:
    """``project_search`` with candidates from the index: the pattern is tried on these, and only the lines of those that match are summed."""
    if not text:
        return project_progress(ledger, where)
    candidates = search_candidates(ledger.sparkSession, index, text)
    matching = candidates.where(matches_search(text, F.col("project"), F.col("cui")))
    by = F.col(s.CUI).eqNullSafe(F.col("cui")) & (F.col(s.PROJECT) == F.col("project"))
    return project_progress(ledger.join(matching, by, "left_semi"), where)
