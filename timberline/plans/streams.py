"""Queries that run the given tables through Structured Streaming to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import operators as op
from timberline.formats import parse_logs
from timberline.plans import views as V
from timberline.plans.analysis import ts_us
from timberline.plans.catalogue import query, with_ctes
from timberline.plans.parsing import _expected
from timberline.session import new_stage_path
from timberline.streaming import LiveLog, live_bars, running_level_counts, stream_table, time_windows, to_table

_HALF_DAY_US = 43_200_000_000


def _live_events(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return V.as_events_log(stream_table(spark, f"{sf}/events.parquet"))


@query(
    "stream_filter",
    with_ctes(V.EVENTS_LOG_SQL, "SELECT line_number, ts_us, level, message FROM log WHERE level >= 3 AND contains(message, 'k\": 3')"),
)
def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.apply_filter(_live_events(spark, sf), op.LogFilter(min_level="warning", text='k": 3'))
    return to_table(rows.select("line_number", ts_us(), "level", "message"), label="stream-filter")


@query("stream_parse", with_ctes(V.EVENTS_LOG_SQL, _expected()))
def stream_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a known format are parsed as they come."""
    lines = _live_events(spark, sf).select(
        F.lit("live").alias("source_id"), "line_number", V.rendered("iso").alias("raw_line")
    )
    parsed = parse_logs(lines, "plain", now="2024-02-01")
    flat = parsed.select("line_number", ts_us(), "level", "message", "component", "thread_id", "source_ref")
    return to_table(flat, label="stream-parse")


@query("stream_level_counts", with_ctes(V.EVENTS_LOG_SQL, "SELECT level, count(*) AS rows FROM log GROUP BY 1"))
def stream_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return to_table(running_level_counts(_live_events(spark, sf)), "complete", "stream-levels")


_WINDOWS_SQL = f"""
windows AS (SELECT ts_us // {_HALF_DAY_US} * {_HALF_DAY_US} AS start_us, (ts_us // {_HALF_DAY_US} + 1) * {_HALF_DAY_US} AS end_us,
       count(*) FILTER (level >= 4) AS err, count(*) FILTER (level = 3) AS warn, count(*) FILTER (level < 3) AS info
FROM log GROUP BY ALL)"""


@query("stream_histogram", with_ctes(V.EVENTS_LOG_SQL, _WINDOWS_SQL, "SELECT * FROM windows"))
def stream_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return to_table(time_windows(_live_events(spark, sf), "12 hours"), "complete", "stream-windows")


@query(
    "stream_live_bars",
    with_ctes(
        V.EVENTS_LOG_SQL,
        _WINDOWS_SQL,
        f"""
ends AS (SELECT min(start_us) AS f, ((max(end_us) - min(start_us)) // {_HALF_DAY_US} + 24) // 25 * {_HALF_DAY_US} AS step FROM windows)
SELECT CAST((start_us - f) // step AS INTEGER) AS bucket, min(f + (start_us - f) // step * step) AS start_us,
       min(f + ((start_us - f) // step + 1) * step) AS end_us, CAST(sum(err) AS BIGINT) AS err, CAST(sum(warn) AS BIGINT) AS warn,
       CAST(sum(info) AS BIGINT) AS info, CAST(sum(err + warn + info) AS BIGINT) AS total
FROM windows, ends GROUP BY 1""",
    ),
)
def stream_live_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The live histogram's view: at most 25 bars, each a whole number of half days."""
    windows = to_table(time_windows(_live_events(spark, sf), "12 hours"), "complete", "stream-windows")
    return live_bars(windows, 25)


@query(
    "stream_merge",
    with_ctes(
        V.EVENTS_LOG_SQL,
        V.ORDERS_LOG_SQL,
        """
SELECT ts_us, level, message, component, 'events' AS source_id, line_number AS source_line_number FROM log
UNION ALL SELECT ts_us, level, message, component, 'orders', line_number FROM orders_log""",
    ),
)
def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["line_number", "timestamp", "level", "message", "component"]
    orders = V.as_orders_log(stream_table(spark, f"{sf}/orders.parquet"))
    merged = op.merge_streams({"events": _live_events(spark, sf).select(columns), "orders": orders.select(columns)})
    flat = merged.select(ts_us(), "level", "message", "component", "source_id", "source_line_number")
    return to_table(flat, label="stream-merge")


@query(
    "stream_live_log",
    with_ctes(
        V.EVENTS_LOG_SQL,
        "SELECT row_number() OVER (ORDER BY ts_us DESC, entry_id) AS line_number, ts_us, level, message, component FROM log",
    ),
)
def stream_live_log(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving lines are numbered in order of arrival and parsed; here the newest came first."""
    log = _live_events(spark, sf)
    lines = log.select(
        F.lit("live").alias("source_id"), V.rendered("iso").alias("raw_line"), "timestamp", "entry_id"
    ).withColumnsRenamed({"timestamp": "_ts", "entry_id": "_entry"})
    root = new_stage_path(spark, "live-log")
    live = LiveLog(f"{root}/log", lambda: [F.desc("_ts"), F.col("_entry")], format="plain")
    writer = lines.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(live).start().awaitTermination()
    return live.rows(spark).select("line_number", ts_us(), "level", "message", "component")
