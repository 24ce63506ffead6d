"""Ledger sources: yearly files and the typed table."""

from fiscal_ledger.sources.files import normalise, read_ledger, scan_files
from fiscal_ledger.sources.manifest import file_manifest
from fiscal_ledger.sources.names import open_names, write_names, write_search_index
from fiscal_ledger.sources.typed import ledger_ingest, open_ledger, write_by_year

__all__ = [
    "file_manifest",
    "ledger_ingest",
    "normalise",
    "open_ledger",
    "open_names",
    "read_ledger",
    "scan_files",
    "write_by_year",
    "write_names",
    "write_search_index",
]
