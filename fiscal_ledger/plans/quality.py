"""What coercion could not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger import schema as s
from fiscal_ledger.sources.files import typed_columns


def coercion_report(raw: DataFrame) -> DataFrame:
    """Per fiscal year and numeric column: values present, and how many of them coercion turns into NULL.

    One scan and one aggregation count all nine columns; only the yearly
    counts are turned into rows.
    """
    typed = typed_columns(raw)
    present = {c: F.count(c) for c in s.COERCED}
    counts = raw.groupBy(typed[s.YEAR].alias("fiscal_year")).agg(
        *[
            F.struct(present[c].alias("present"), (present[c] - F.count(typed[c])).alias("rejected")).alias(c)
            for c in s.COERCED
        ]
    )
    return counts.unpivot("fiscal_year", list(s.COERCED), "column_name", "counts").select(
        "fiscal_year", "column_name", "counts.present", "counts.rejected"
    )
