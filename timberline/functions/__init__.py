"""Scalar functions: pure column expressions, no UDFs."""

from timberline.functions.codes import code_hex, extract_error_tokens, parse_code
from timberline.functions.display import (
    compact_count,
    format_bytes,
    format_clock,
    format_count,
    format_datetime,
    level_display,
    level_name,
    level_short,
    metadata_line,
)
from timberline.functions.levels import (
    detect_level,
    interpret_bracket_tag,
    parse_level_and_component,
    recognized_level,
)
from timberline.functions.text import basename, csv_field, json_get_ci, split_csv_row
from timberline.functions.times import epoch_number, infer_year, parse_timestamp

__all__ = [
    "basename",
    "code_hex",
    "compact_count",
    "csv_field",
    "detect_level",
    "epoch_number",
    "extract_error_tokens",
    "format_bytes",
    "format_clock",
    "format_count",
    "format_datetime",
    "infer_year",
    "interpret_bracket_tag",
    "json_get_ci",
    "level_display",
    "level_name",
    "level_short",
    "metadata_line",
    "parse_code",
    "parse_level_and_component",
    "parse_timestamp",
    "recognized_level",
    "split_csv_row",
]
