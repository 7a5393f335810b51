"""Queries that go through files: the given tables rendered as log files, read back by each source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import operators as op
from timberline.formats import LogFormat, detect_format, parse_logs, register_format, struct_parse, unregister_format
from timberline.plans import views as V
from timberline.plans.analysis import SHORT_LEVEL_SQL, ts_us
from timberline.plans.catalogue import query, with_ctes
from timberline.plans.parsing import _expected
from timberline.session import new_stage_path
from timberline.sinks import write_csv, write_json, write_text
from timberline.sources import (
    compact_ingested, ingest_changed, log_catalog, read_heads, read_ingested, read_json_array, read_log_lines, read_log_table, read_logs,
    write_log_table,
)
from timberline.streaming import tail_log_lines

#: Events in a rendered file.
PER_FILE = 500


def _file_of() -> Column:
    return F.call_function("div", F.col("entry_id"), F.lit(PER_FILE).cast("long"))


def _write_files(lines: DataFrame, label: str, mode: str = "overwrite", root: str | None = None, **options: str) -> str:
    """Lines ``(file, entry_id, value)`` as a folder ``file=..`` with one text file each, in order; its pattern."""
    root = root or new_stage_path(lines.sparkSession, label)
    dealt = lines.repartition("file").sortWithinPartitions("file", "entry_id").select("file", "value")
    dealt.write.mode(mode).partitionBy("file").options(**options).text(root)
    return f"{root}/file=*"


def _events_files(spark: SparkSession, sf: str, fmt: str, label: str, **options: str) -> str:
    log = V.events_log(spark, sf)
    return _write_files(log.select(_file_of().alias("file"), "entry_id", V.rendered(fmt).alias("value")), label, **options)


def _number_of_file() -> Column:
    return F.regexp_extract("source_id", r"file=(\d+)", 1).cast("long")


_NUMBERED = f"numbered AS (SELECT *, entry_id // {PER_FILE} AS file, row_number() OVER (PARTITION BY entry_id // {PER_FILE} ORDER BY entry_id) AS n FROM log)"
_LINES_SQL = with_ctes(V.EVENTS_LOG_SQL, _NUMBERED, "SELECT file, n AS line_number, n - 1 AS entry_id, ts_us, level, message, component FROM numbered")


def _lines(spark: SparkSession, pattern: str) -> DataFrame:
    rows = parse_logs(read_log_lines(spark, pattern), "plain", now="2024-02-01")
    return rows.select(_number_of_file().alias("file"), "line_number", "entry_id", ts_us(), "level", "message", "component")


@query("file_lines", _LINES_SQL)
def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of many files with their numbers in the file."""
    return _lines(spark, _events_files(spark, sf, "iso", "lines"))


@query("file_lines_gzip", _LINES_SQL)
def file_lines_gzip(spark: SparkSession, sf: str) -> DataFrame:
    """The same from gzip files whose lines end with carriage return and line feed."""
    return _lines(spark, _events_files(spark, sf, "iso", "gzip", compression="gzip", lineSep="\r\n"))


@query(
    "file_catalog",
    with_ctes(
        V.EVENTS_LOG_SQL, _NUMBERED,
        """
SELECT file, 'log' AS category, CAST(sum(strlen('[' || upper((['debug', 'info', 'notice', 'warning', 'error', 'critical'])[level + 1]) || '] '
       || component || ': ' || message) + 1) AS BIGINT) AS size FROM numbered GROUP BY file""",
    ),
)
def file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """What files there are, and how large."""
    log = V.events_log(spark, sf).where("level >= 0")
    rest = V.events_log(spark, sf).where("level < 0")
    line = lambda df: df.select(_file_of().alias("file"), "entry_id", V.rendered("level_prefix").alias("value"))
    pattern = _write_files(line(log).unionByName(line(rest)), "catalog")
    found = log_catalog(spark, pattern).withColumn("file", F.regexp_extract("path", r"file=(\d+)", 1).cast("long"))
    return found.select("file", "category", "size")


@query(
    "file_formats",
    with_ctes(
        V.EVENTS_LOG_SQL,
        """
kinds AS (SELECT DISTINCT user_id % 5 AS kind FROM log)
SELECT kind, (['sccm', 'json', 'unified', 'plain', 'plain'])[kind + 1] AS format FROM kinds""",
    ),
)
def file_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats of files of five kinds, from their first lines alone."""
    lines = V.mixed_lines(spark, sf).withColumn("user", F.regexp_extract("source_id", r"(\d+)", 1).cast("long"))
    files = lines.select((F.col("user") % 5).alias("file"), F.struct("user", "line_number").alias("entry_id"), F.col("raw_line").alias("value"))
    kinds = detect_format(read_heads(spark, _write_files(files, "formats")))
    return kinds.select(_number_of_file().alias("kind"), "format")


_RECORDS_SQL = with_ctes(V.EVENTS_LOG_SQL, "SELECT ts_us, level, message, component FROM log")


@query("ingest_rows", _RECORDS_SQL)
def ingest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A folder is ingested twice, the second time after files were added and replaced, then compacted."""
    root, table = new_stage_path(spark, "incoming"), new_stage_path(spark, "ingested")
    log = V.events_log(spark, sf).select(_file_of().alias("file"), "entry_id", V.rendered("iso").alias("value"))
    _write_files(log.where("entry_id % 3 > 0"), "incoming", root=root)
    pattern = f"{root}/file=*"
    ingest_changed(spark, log_catalog(spark, pattern), table, now="2024-02-01")
    _write_files(log, "incoming", root=root)
    ingest_changed(spark, log_catalog(spark, pattern), table, now="2024-02-01")
    compact_ingested(spark, table)
    return read_ingested(spark, table).select(ts_us(), "level", "message", "component")


@query(
    "log_table_day",
    with_ctes(V.EVENTS_LOG_SQL, "SELECT entry_id, ts_us, level, component FROM log WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11 12:00:00'"),
)
def log_table_day(spark: SparkSession, sf: str) -> DataFrame:
    """A day and a half from a stored table; the other days' files aren't read."""
    path = new_stage_path(spark, "log-table")
    log = V.events_log(spark, sf)
    missing = {c: F.lit(None).cast("string") for c in ("raw_line", "thread_id", "source_ref")}
    write_log_table(log.withColumns(missing | {"source_line_number": F.col("line_number")}), path)
    rows = read_log_table(spark, path)
    first, last = F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp(F.lit("2024-01-11 12:00:00"))
    days = F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-11").cast("date"))
    return rows.where(days & (F.col("timestamp") >= first) & (F.col("timestamp") < last)).select("entry_id", ts_us(), "level", "component")


def _array_files(spark: SparkSession, sf: str, envelope: bool) -> str:
    """Events as JSON arrays over several lines, a file each."""
    log = V.events_log(spark, sf).select(_file_of().alias("file"), "entry_id", V.rendered("json").alias("value"))
    whole = log.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "value"))), lambda r: r["value"]), ",\n  ").alias("all"))
    head, tail = ('{"host": {"logs": [1]}, "records": [\n  ', '\n], "end": "]}"}') if envelope else ("[\n  ", "\n]")
    text = F.concat(F.lit(head), "all", F.lit(tail))
    return _write_files(whole.select("file", F.lit(0).alias("entry_id"), text.alias("value")), "arrays")


_ARRAY_SQL = with_ctes(V.EVENTS_LOG_SQL, _NUMBERED, "SELECT file, n AS line_number, CAST(entry_id AS VARCHAR) AS thread_id, message, component FROM numbered")


def _array_rows(rows: DataFrame) -> DataFrame:
    return rows.select(_number_of_file().alias("file"), "line_number", "thread_id", "message", "component")


@query("json_array_rows", _ARRAY_SQL)
def json_array_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records of envelopes around a JSON array, in blocks far smaller than the files."""
    pattern = _array_files(spark, sf, envelope=True)
    return _array_rows(parse_logs(read_json_array(spark, pattern, block=1 << 14), "json"))


@query("json_array_auto", _ARRAY_SQL)
def json_array_auto(spark: SparkSession, sf: str) -> DataFrame:
    """JSON arrays opened like any other file: what they are shows in their first lines."""
    return _array_rows(read_logs(spark, _array_files(spark, sf, envelope=False)))


@query("tail_events", _RECORDS_SQL)
def tail_events(spark: SparkSession, sf: str) -> DataFrame:
    """A folder followed over three runs of a query, more files coming in between them."""
    root = new_stage_path(spark, "tail")
    log = V.events_log(spark, sf).select("entry_id", V.rendered("iso").alias("value"))
    for run in range(3):
        log.where(F.pmod(F.xxhash64("entry_id"), F.lit(3)) == run).select("value").write.mode("append").text(f"{root}/logs")
        stream = tail_log_lines(spark, f"{root}/logs", split_bytes=1 << 20)
        writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
    rows = parse_logs(spark.read.parquet(f"{root}/rows"), "plain", now="2024-02-01")
    return rows.select(ts_us(), "level", "message", "component")


def _exported(spark: SparkSession, sf: str, write) -> DataFrame:
    path = f"{new_stage_path(spark, 'export')}/{uuid.uuid4().hex}"
    write(V.events_log(spark, sf).withColumn("raw_line", V.rendered("iso")), path)
    return spark.read.text(path)


@query("text_export", with_ctes(V.EVENTS_LOG_SQL, _expected().replace("line_number AS line_number", "entry_id + 1 AS line_number")))
def text_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported lines parsed again; the number comes from joining them to the events by their text."""
    back = _exported(spark, sf, write_text).withColumnRenamed("value", "raw_line")
    lines = V.events_log(spark, sf).select("line_number", V.rendered("iso").alias("raw_line"), F.lit("file").alias("source_id"))
    rows = parse_logs(lines.join(back, "raw_line"), "plain", now="2024-02-01")
    return rows.select("line_number", ts_us(), "level", "message", "component", "thread_id", "source_ref")


@query(
    "csv_export",
    with_ctes(
        V.EVENTS_LOG_SQL,
        f"SELECT line_number, {SHORT_LEVEL_SQL} AS level, component, message FROM log",
    ),
)
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported CSV files read back by Spark's own reader."""
    path = f"{new_stage_path(spark, 'export')}/csv"
    write_csv(V.events_log(spark, sf), path)
    rows = spark.read.option("escape", '"').schema("Line string, Timestamp string, Level string, Component string, Message string").csv(path)
    rows = rows.where(F.col("Line") != "Line")
    return rows.select(F.col("Line").cast("long").alias("line_number"), F.col("Level").alias("level"), F.col("Component").alias("component"), F.col("Message").alias("message"))


@query("json_export", with_ctes(V.EVENTS_LOG_SQL, "SELECT line_number, component, message FROM log"))
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported JSON lines read back by Spark's own reader."""
    path = f"{new_stage_path(spark, 'export')}/json"
    write_json(V.events_log(spark, sf), path)
    rows = spark.read.schema("component string, level string, line long, message string").json(path)
    return rows.select(F.col("line").alias("line_number"), "component", "message")


def _pipe_fields(line: Column, number: Column) -> Column:
    part = F.split(line, r"\|", 4)
    return F.struct(
        F.timestamp_micros(F.get(part, F.lit(0)).cast("long")).alias("timestamp"), F.get(part, F.lit(1)).cast("int").alias("level"),
        F.get(part, F.lit(3)).alias("message"), F.get(part, F.lit(2)).alias("component"), F.lit(None).cast("string").alias("thread_id"),
        F.lit(None).cast("string").alias("source_ref"),
    )


@query("own_format", _RECORDS_SQL)
def own_format(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a format that the user adds, recognised by its own score."""
    log = V.events_log(spark, sf)
    line = F.concat_ws("|", F.unix_micros("timestamp").cast("string"), F.col("level").cast("string"), "component", "message")
    pattern = _write_files(log.select(_file_of().alias("file"), "entry_id", line.alias("value")), "pipes")
    score = lambda sample: F.when(sample.first.rlike(r"^\d+\|-?\d+\|[^|]*\|"), F.lit(0.95)).otherwise(F.lit(0.0))
    register_format(LogFormat("pipes", score, struct_parse(_pipe_fields)))
    try:
        rows = op.apply_filter(read_logs(spark, pattern), op.LogFilter())
        return rows.select(ts_us(), "level", "message", "component")
    finally:
        unregister_format("pipes")
