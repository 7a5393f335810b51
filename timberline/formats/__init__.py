"""Log formats: how each is recognised and parsed."""

from timberline.formats.base import LogFormat, ParseContext, Sample, struct_parse
from timberline.formats.plain import SHAPES, line_shape
from timberline.formats.registry import (
    detect_format,
    formats,
    parse_logs,
    register_format,
    unregister_format,
)

__all__ = [
    "SHAPES",
    "LogFormat",
    "ParseContext",
    "Sample",
    "detect_format",
    "formats",
    "line_shape",
    "parse_logs",
    "register_format",
    "struct_parse",
    "unregister_format",
]
