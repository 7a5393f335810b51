"""Sinks."""

from timberline.sinks.export import (
    CSV_HEADER,
    to_csv_lines,
    to_json_records,
    write_csv,
    write_json,
    write_text,
)

__all__ = ["CSV_HEADER", "to_csv_lines", "to_json_records", "write_csv", "write_json", "write_text"]
