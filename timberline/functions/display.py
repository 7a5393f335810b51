"""Text shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.schema import LEVELS


def _level_text(level: Column, position: int) -> Column:
    out = None
    for row in LEVELS:
        out = (out.when if out is not None else F.when)(level == row[0], F.lit(row[position]))
    return out


def level_name(level: Column) -> Column:
    return _level_text(level, 1)


def level_display(level: Column) -> Column:
    return _level_text(level, 2)


def level_short(level: Column) -> Column:
    return _level_text(level, 3)


def format_bytes(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``120 MB``: steps of 1024, no decimal from 100 up, ties to even."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.when(size < 1024, F.format_string("%d B", size.cast("long")))
    for power, unit in enumerate(units, start=1):
        value = size.cast("double") / float(1024**power)
        text = F.when(value >= 100, F.format_string(f"%.0f {unit}", F.bround(value, 0))).otherwise(
            F.format_string(f"%.1f {unit}", F.bround(value, 1))
        )
        out = out.when(size < 1024 ** (power + 1), text) if unit != units[-1] else out.otherwise(text)
    return out


def format_count(n: Column) -> Column:
    """``1,234``."""
    return F.format_number(n.cast("long"), 0)


# Halfway counts whose thousandth, as a double, lies above the halfway point and so rounds up.
_ROUND_UP = [n for n in range(1_050, 10_000, 100) if float(f"{n / 1000:.1f}") * 1000 > n]


def compact_count(n: Column) -> Column:
    """``950``, ``1.2k``, ``34k``."""
    whole = F.format_string("%dk", F.floor(n / 1000).cast("long"))
    up = (F.pmod(n, F.lit(100)) > 50) | n.isin(*_ROUND_UP)
    tenths = F.floor(n / 100).cast("long") + F.when(up, 1).otherwise(0)
    short = F.format_string("%d.%dk", F.floor(tenths / 10).cast("long"), F.pmod(tenths, F.lit(10)))
    return (
        F.when(n >= 10_000, whole)
        .when(n >= 1_000, F.replace(short, F.lit(".0k"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def format_clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def format_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def metadata_line(timestamp: Column, component: Column, thread_id: Column, level: Column) -> Column:
    """``time · component · thread t · Level`` without the absent parts."""
    return F.concat_ws(
        " · ",
        format_datetime(timestamp),
        component,
        F.concat(F.lit("thread "), thread_id),
        level_display(level),
    )
