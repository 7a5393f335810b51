"""Structured Streaming forms."""

from timberline.streaming.live import (
    LiveLog,
    live_bars,
    running_level_counts,
    stream_log_lines,
    stream_table,
    time_windows,
    to_table,
)
from timberline.streaming.rates import rate_and_stall
from timberline.streaming.tail import tail_log_lines

__all__ = [
    "LiveLog",
    "live_bars",
    "rate_and_stall",
    "running_level_counts",
    "stream_log_lines",
    "stream_table",
    "tail_log_lines",
    "time_windows",
    "to_table",
]
