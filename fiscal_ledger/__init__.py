"""Audit queries over public-budget ledgers, on Spark.

    from fiscal_ledger import LedgerFilter, open_ledger, plans

    ledger = open_ledger(spark, "s3a://.../ledger")
    plans.project_progress(ledger, LedgerFilter(year=2025, sector="EDUCACION")).show()
"""

from fiscal_ledger.operators.filters import LedgerFilter
from fiscal_ledger.sources import ledger_ingest, normalise, open_ledger, read_ledger, scan_files

__all__ = ["LedgerFilter", "ledger_ingest", "normalise", "open_ledger", "read_ledger", "scan_files"]
