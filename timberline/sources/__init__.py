"""Sources: files, folders, stored tables."""

from timberline.sources.catalog import file_category, log_catalog
from timberline.sources.files import read_logs
from timberline.sources.heads import read_heads
from timberline.sources.json_arrays import read_json_array
from timberline.sources.lines import read_log_lines
from timberline.sources.tables import (
    changed_files,
    compact_ingested,
    current_files,
    ingest_changed,
    read_ingested,
    read_log_table,
    write_log_table,
)

__all__ = [
    "changed_files",
    "compact_ingested",
    "current_files",
    "file_category",
    "ingest_changed",
    "log_catalog",
    "read_heads",
    "read_ingested",
    "read_json_array",
    "read_log_lines",
    "read_log_table",
    "read_logs",
    "write_log_table",
]
