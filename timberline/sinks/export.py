"""Export as text, CSV and JSON lines, in log order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.display import format_datetime, level_display, level_short
from timberline.functions.text import csv_field

CSV_HEADER = "Line,Timestamp,Level,Component,Message"


def to_csv_lines(df: DataFrame, name: str = "value") -> DataFrame:
    """Add the CSV form of each row: line and level bare, the rest always quoted."""
    return df.withColumn(
        name,
        F.concat_ws(
            ",",
            F.col("line_number").cast("string"),
            csv_field(format_datetime(F.col("timestamp"))),
            level_short(F.col("level")),
            csv_field(F.col("component")),
            csv_field(F.col("message")),
        ),
    )


def to_json_records(df: DataFrame, name: str = "value") -> DataFrame:
    """Add the JSON form of each row: keys sorted, absent time and component left out."""
    return df.withColumn(
        name,
        F.to_json(
            F.struct(
                "component",
                level_display(F.col("level")).alias("level"),
                F.col("line_number").alias("line"),
                "message",
                format_datetime(F.col("timestamp")).alias("timestamp"),
            )
        ),
    )


def _write(df: DataFrame, path: str, mode: str) -> None:
    ordered = df.orderBy("source_id", "line_number").select("value")
    ordered.write.mode(mode).text(path)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The lines as they were read."""
    _write(df.withColumn("value", F.col("raw_line")), path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files in order; the header is the first line of the first part."""
    rows = to_csv_lines(df).select("source_id", "line_number", "value")
    # Nulls sort first, so the header row leads.
    header = df.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("source_id"),
        F.lit(None).cast("long").alias("line_number"),
        F.lit(CSV_HEADER).alias("value"),
    )
    _write(header.unionByName(rows), path, mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    _write(to_json_records(df), path, mode)
