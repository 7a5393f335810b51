"""The one record every format is normalised to, and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity scale: rank, name, display name, short name (fixed values).
LEVELS: list[tuple[int, str, str, str]] = [
    (-1, "unknown", "Unknown", "???"),
    (0, "debug", "Debug", "DBG"),
    (1, "info", "Info", "INFO"),
    (2, "notice", "Notice", "NOT"),
    (3, "warning", "Warning", "WARN"),
    (4, "error", "Error", "ERR"),
    (5, "critical", "Critical", "CRT"),
]

UNKNOWN, DEBUG, INFO, NOTICE, WARNING, ERROR, CRITICAL = (rank for rank, *_ in LEVELS)
LEVEL_RANK: dict[str, int] = {name: rank for rank, name, _, _ in LEVELS}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_line_number", T.LongType()),
    ]
)

LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# What a format's parse yields for one line; the rest of the record comes from the reader.
PARSED_FIELDS = ["timestamp", "level", "message", "component", "thread_id", "source_ref"]
PARSED_TYPE = T.StructType([LOG_SCHEMA[name] for name in PARSED_FIELDS])


def level_rank(level: int | str) -> int:
    """Accept a rank or a level name."""
    if isinstance(level, str):
        return LEVEL_RANK[level.lower()]
    if level not in LEVEL_RANK.values():
        raise ValueError(f"no such level: {level}")
    return level


def parsed_struct(
    timestamp: Column | None = None,
    level: Column | int = INFO,
    message: Column | None = None,
    component: Column | None = None,
    thread_id: Column | None = None,
    source_ref: Column | None = None,
) -> Column:
    """Build the parse result with its fixed field order and types."""
    given = {
        "timestamp": timestamp,
        "level": F.lit(level) if isinstance(level, int) else level,
        "message": message,
        "component": component,
        "thread_id": thread_id,
        "source_ref": source_ref,
    }
    return F.struct(
        *[
            (F.lit(None) if value is None else value).cast(LOG_SCHEMA[name].dataType).alias(name)
            for name, value in given.items()
        ]
    )


def to_log(df: DataFrame) -> DataFrame:
    """Select the record columns, adding absent ones as null, in schema order."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_SCHEMA
        ]
    )
