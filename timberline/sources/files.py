"""Log files of any kind to records, the way a user opens a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.formats import detect_format, parse_logs
from timberline.functions.text import parse_json_object, trim_blank_lines
from timberline.session import stage
from timberline.sources.heads import file_list, heads_of
from timberline.sources.json_arrays import array_objects, array_ranges
from timberline.sources.lines import read_log_lines


def file_kinds(heads: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(path, source_id, size, format, whole)`` of listed files by their first lines.

    ``whole`` marks files that may be one JSON value: of a JSON format, and not a complete object on the
    first line with more lines after it.
    """
    first = heads.groupBy("source_id").agg(
        F.min_by("raw_line", "line_number").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    lone = parse_json_object(trim_blank_lines(F.col("_first"))).isNull() | (F.col("_lines") == 1)
    text = F.ltrim("_first")
    kind = F.col("format")
    whole = (kind.isin("json", "unified") & text.startswith("[") | (kind == "json") & text.startswith("{")) & lone
    kinds = detect_format(heads).join(first, "source_id").select("source_id", "format", F.coalesce(whole, F.lit(False)).alias("whole"))
    return sizes.join(kinds, "source_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))


def open_logs(
    spark: SparkSession, path: str | list[str], format: str = "auto", tz: str = "UTC", now=None, honor_offset: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The records of :func:`read_logs`, and ``(path, source_id, size, format)`` of the files."""
    listed = file_list(spark, path)
    heads = stage(heads_of(listed), "heads")
    lines = read_log_lines(spark, path)
    if format != "auto":
        kinds = listed.withColumn("format", F.lit(format))
        return parse_logs(lines, format, tz, now, honor_offset, heads=heads), kinds
    kinds = stage(file_kinds(heads, listed), "kinds")
    maybe = kinds.where(F.col("whole") & ~F.col("path").endswith(".gz"))
    files = kinds.select("path", "source_id", "size", "format")
    if maybe.isEmpty():
        return parse_logs(lines, "auto", tz, now, honor_offset, heads=heads), files
    ranges = array_ranges(maybe)
    arrays = stage(ranges.select("source_id").distinct(), "arrays")
    by_line = lines.join(arrays, "source_id", "left_anti")
    records = parse_logs(by_line, "auto", tz, now, honor_offset, heads=heads.join(arrays, "source_id", "left_anti"))
    objects = array_objects(ranges).join(maybe.select("source_id", "format"), "source_id")
    objects = objects.withColumn("entry_id", F.col("line_number") - 1)
    return records.unionByName(parse_logs(objects, "column", tz, now, honor_offset)), files


def read_logs(
    spark: SparkSession, path: str | list[str], format: str = "auto", tz: str = "UTC", now=None, honor_offset: bool = False
) -> DataFrame:
    """Records of log files: plain or gzip text, JSON lines, JSON arrays and envelopes, reports.

    ``auto`` looks at the first lines of each file and at no more. A file of a JSON format that is one array
    of objects, or an envelope around one, gives a record per object; if it isn't one after all, it is read
    line by line. (System logs count as such only as a bare array.) Other formats go by lines.
    """
    return open_logs(spark, path, format, tz, now, honor_offset)[0]
