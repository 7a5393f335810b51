"""Queries that render the given events as log lines of a format and parse them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.formats import detect_format, line_shape, parse_logs
from timberline.functions import detect_level, level_name, parse_timestamp, split_csv_row
from timberline.functions.text import trim_blanks
from timberline.plans import views as V
from timberline.plans.catalogue import query, with_ctes

NOW = "2024-02-01"

ERROR_RE = r"\b(error|failed|failure|fatal|crash(ed)?|panic|abort(ed)?|exception|critical|severe)\b"
WARN_RE = r"\b(warn(ing)?|caution|deprecated|retrying|timeout|timed out)\b"
DEBUG_RE = r"\b(debug|trace|verbose)\b"


def keyword_level_sql(text: str) -> str:
    return (
        f"CAST(CASE WHEN regexp_matches({text}, '{ERROR_RE}', 'i') THEN 4 "
        f"WHEN regexp_matches({text}, '{WARN_RE}', 'i') THEN 3 "
        f"WHEN regexp_matches({text}, '{DEBUG_RE}', 'i') THEN 0 ELSE 1 END AS INTEGER)"
    )


def _flat(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "line_number",
        F.unix_micros("timestamp").alias("ts_us"),
        "level",
        "message",
        "component",
        "thread_id",
        "source_ref",
    )


def _parse_query(name: str, fmt: str, parser: str, sql: str) -> None:
    @query(name, with_ctes(V.EVENTS_LOG_SQL, sql))
    def plan(spark: SparkSession, sf: str) -> DataFrame:
        return _flat(parse_logs(V.events_lines(spark, sf, fmt), parser, tz="UTC", now=NOW))


def _expected(**columns: str) -> str:
    given = {
        "line_number": "line_number", "ts_us": "ts_us", "level": "level", "message": "message",
        "component": "component", "thread_id": "CAST(NULL AS VARCHAR)", "source_ref": "CAST(NULL AS VARCHAR)",
    } | columns
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in given.items()) + " FROM log"


_MS = "ts_us - ts_us % 1000"
# A message that starts with the word "error" loses it to the level.
_WORD_LEVEL = "CAST(CASE WHEN event_type = 'error' THEN 4 ELSE 1 END AS INTEGER)"
_WORD_REST = "CASE WHEN event_type = 'error' THEN props ELSE message END"
_LEVEL_NAME = "(['debug', 'info', 'notice', 'warning', 'error', 'critical'])[level + 1]"

_parse_query("parse_dated_syslog", "dated_syslog", "plain", _expected(level=_WORD_LEVEL, message=_WORD_REST))
_parse_query("parse_bsd_syslog", "bsd_syslog", "plain", _expected(ts_us="ts_us - ts_us % 1000000"))
_parse_query("parse_apple_daemon", "apple_daemon", "plain", _expected(ts_us=_MS, level=_WORD_LEVEL))
_parse_query(
    "parse_bracketed", "bracketed", "plain",
    _expected(component="CASE WHEN entry_id % 2 = 0 THEN component END"),
)
_parse_query("parse_prefix_tagged", "prefix_tagged", "plain", _expected())
_parse_query("parse_logfmt", "logfmt", "plain", _expected(component="CAST(NULL AS VARCHAR)"))
_parse_query(
    "parse_dated_component", "dated_component", "plain", _expected(level=_WORD_LEVEL, message=_WORD_REST)
)
_parse_query("parse_iso", "iso", "plain", _expected())
_parse_query("parse_level_prefix", "level_prefix", "plain", _expected(ts_us="CAST(NULL AS BIGINT)"))
_parse_query(
    "parse_bare_text", "bare_text", "plain",
    _expected(
        ts_us="CAST(NULL AS BIGINT)", level=_WORD_LEVEL, component="CAST(NULL AS VARCHAR)",
        message="component || ' met ' || message",
    ),
)
_parse_query(
    "parse_sccm", "sccm", "sccm",
    _expected(
        ts_us=_MS,
        level="CAST(CASE WHEN level >= 4 THEN 4 WHEN level = 3 THEN 3 ELSE 1 END AS INTEGER)",
        thread_id="CAST(entry_id AS VARCHAR)", source_ref="source_id",
    ),
)
_parse_query(
    "parse_json", "json", "json",
    _expected(
        ts_us="CASE WHEN entry_id % 2 = 0 THEN ts_us ELSE ts_us - ts_us % 1000 END",
        thread_id="CAST(entry_id AS VARCHAR)",
    ),
)
_parse_query(
    "parse_unified", "unified", "unified",
    _expected(
        level="CAST(CASE level WHEN 5 THEN 5 WHEN 4 THEN 4 WHEN 2 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS INTEGER)",
        component="CASE entry_id % 3 WHEN 0 THEN event_type WHEN 1 THEN component || ':net' ELSE component END",
        thread_id="CAST(entry_id AS VARCHAR)",
    ),
)
_parse_query(
    "parse_csv", "csv", "csv",
    _expected(
        line_number="line_number + 1", message="replace(message, '\"', '') || ', seen on the front page'",
    )
    + """
UNION ALL
SELECT 1, NULL, 0, 'CSV Header: timestamp,level,component,message', NULL, NULL, NULL FROM (SELECT count(*) FROM log)""",
)


def _report_query(kind: str, sql: str) -> None:
    @query(f"parse_{kind}", with_ctes(V.EVENTS_LOG_SQL, sql))
    def plan(spark: SparkSession, sf: str) -> DataFrame:
        parsed = parse_logs(V.report_lines(spark, sf, kind), kind)
        return parsed.select(
            "source_id", "line_number", F.unix_micros("timestamp").alias("ts_us"), "level", "message", "component",
            "source_ref",
        )


_report_query(
    "ips",
    f"""
SELECT 'ips-' || entry_id AS source_id, n AS line_number, {_MS} AS ts_us,
       CAST(CASE WHEN n > 0 THEN 1 ELSE CASE level WHEN 5 THEN 5 WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 1 END END AS INTEGER) AS level,
       CASE n WHEN 0 THEN component || ' — bug_type ' ||
                (['?', '777', '298', '288', '309', '110'])[level + 1] || ' · incident I' || entry_id || ' · OS 1'
              WHEN 1 THEN '{{"timestamp":"' || strftime(make_timestamp({_MS}), '%Y-%m-%d %H:%M:%S.%g') || ' +0000","app_name":"' || component ||
                '"' || CASE WHEN level = 0 THEN '' ELSE ',"bug_type":"' || (['?', '777', '298', '288', '309', '110'])[level + 1] || '"' END
                || ',"incident_id":"I' || entry_id || '","os_version":"OS 1"}}'
              WHEN 2 THEN '{{' WHEN 3 THEN '  "reason": "' || event_type || '"' ELSE '}}' END AS message,
       component, CASE WHEN n = 0 THEN 'header' END AS source_ref
FROM log, range(0, 5) r(n)""",
)
_report_query(
    "diag",
    f"""
SELECT 'diag-' || entry_id AS source_id, n AS line_number,
       CASE WHEN n = 4 THEN ts_us - ts_us % 1000000 + 3600000000 ELSE {_MS} END AS ts_us,
       CAST(CASE WHEN n = 3 AND event_type = 'error' THEN 4 WHEN n = 4 AND level >= 4 THEN 5 WHEN n = 4 THEN 3 ELSE 1 END AS INTEGER) AS level,
       CASE n WHEN 1 THEN 'Date/Time:        ' || strftime(make_timestamp({_MS}), '%Y-%m-%d %H:%M:%S.%g') || ' +0000'
              WHEN 2 THEN 'OS Version: 1' WHEN 3 THEN 'Event: ' || event_type
              ELSE strftime(make_timestamp(ts_us + 3600000000), '%Y-%m-%d %H:%M:%S') || ' +0000 ' ||
                   CASE WHEN level >= 4 THEN 'Panic' ELSE 'hang' END || ' seen' END AS message,
       CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS source_ref
FROM log, range(1, 5) r(n)""",
)


@query(
    "detect_format",
    with_ctes(
        V.EVENTS_LOG_SQL,
        """
SELECT DISTINCT component AS source_id,
       (['sccm', 'json', 'unified', 'plain', 'plain'])[1 + user_id % 5] AS format,
       ([0.95, 0.85, 0.9, 0.1, 0.1])[1 + user_id % 5]::DOUBLE AS score
FROM log""",
    ),
)
def detect_formats(spark: SparkSession, sf: str) -> DataFrame:
    return detect_format(V.mixed_lines(spark, sf))


@query(
    "parse_mixed",
    with_ctes(
        V.EVENTS_LOG_SQL,
        f"""
SELECT component AS source_id,
       row_number() OVER (PARTITION BY component ORDER BY entry_id) AS line_number,
       CASE WHEN user_id % 5 = 0 OR (user_id % 5 = 1 AND entry_id % 2 = 1) THEN {_MS} ELSE ts_us END AS ts_us,
       CAST(CASE WHEN user_id % 5 = 0 THEN CASE WHEN level >= 4 THEN 4 WHEN level = 3 THEN 3 ELSE 1 END
            WHEN user_id % 5 = 2 THEN CASE level WHEN 3 THEN 1 ELSE level END
            ELSE level END AS INTEGER) AS level,
       message,
       CASE WHEN user_id % 5 = 2 THEN CASE entry_id % 3 WHEN 0 THEN event_type WHEN 1 THEN component || ':net' ELSE component END
            WHEN user_id % 5 = 4 THEN CASE WHEN entry_id % 2 = 0 THEN component END
            ELSE component END AS component,
       CASE WHEN user_id % 5 < 3 THEN CAST(entry_id AS VARCHAR) END AS thread_id
FROM log""",
    ),
)
def parse_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of files in different formats, each recognised and parsed."""
    parsed = parse_logs(V.mixed_lines(spark, sf), "auto", now=NOW)
    return parsed.select(
        "source_id", "line_number", F.unix_micros("timestamp").alias("ts_us"), "level", "message", "component",
        "thread_id",
    )


@query("number_document_lines", with_ctes(V.DOCUMENT_LINES_SQL, "SELECT source_id, line_number, raw_line FROM doc_lines"))
def number_document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return V.document_lines(spark, sf)


@query(
    "document_line_levels",
    with_ctes(
        V.DOCUMENT_LINES_SQL,
        f"""
SELECT level, count(*) AS lines, CAST(sum(length(raw_line)) AS BIGINT) AS chars
FROM (SELECT raw_line, {keyword_level_sql('raw_line')} AS level FROM doc_lines) GROUP BY level""",
    ),
)
def document_line_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.document_lines(spark, sf)
    return lines.groupBy(detect_level(F.col("raw_line")).alias("level")).agg(
        F.count("*").alias("lines"), F.sum(F.length("raw_line")).alias("chars")
    )


@query(
    "document_line_shapes",
    with_ctes(
        V.DOCUMENT_LINES_SQL,
        r"""
SELECT CAST(CASE WHEN regexp_matches(t, '^\[?(DEBUG|INFO|NOTICE|WARN(ING)?|ERROR|ERR|CRITICAL|FATAL|CRIT)\b', 'i') THEN 9
            ELSE 10 END AS INTEGER) AS shape, count(*) AS lines
FROM (SELECT trim(raw_line, ' ' || chr(9) || chr(160)) AS t FROM doc_lines) GROUP BY 1""",
    ),
)
def document_line_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Prose has no line that looks like a timestamped log line."""
    lines = V.document_lines(spark, sf)
    return lines.groupBy(line_shape(trim_blanks(F.col("raw_line"))).alias("shape")).agg(F.count("*").alias("lines"))


@query(
    "timestamp_forms",
    with_ctes(
        V.EVENTS_LOG_SQL,
        """
SELECT entry_id, ts_us AS plain_us,
       CASE WHEN entry_id % 4 IN (0, 1) THEN ts_us END AS json_us,
       CASE WHEN entry_id % 4 IN (1, 2) THEN ts_us END AS unified_us
FROM log""",
    ),
)
def timestamp_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Which parser accepts which form: T with offset, none, space with offset, T without."""
    forms = [
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'", "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "yyyy-MM-dd HH:mm:ss.SSSSSS'+0000'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    ]
    texts = F.array(*[F.date_format("timestamp", f) for f in forms])
    lines = V.events_log(spark, sf).select("entry_id", F.get(texts, (F.col("entry_id") % 4).cast("int")).alias("text"))
    return lines.select(
        "entry_id", *[F.unix_micros(parse_timestamp(F.col("text"), k)).alias(f"{k}_us") for k in ("plain", "json", "unified")]
    )


@query(
    "split_csv_rows",
    with_ctes(
        V.EVENTS_LOG_SQL,
        """
SELECT entry_id, CAST(4 AS INTEGER) AS fields, component AS third,
       replace(message, '"', '') || ', seen on the front page' AS fourth FROM log""",
    ),
)
def split_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.events_log(spark, sf).select("entry_id", split_csv_row(V.rendered("csv")).alias("cols"))
    return rows.select(
        "entry_id", F.size("cols").alias("fields"), F.get("cols", F.lit(2)).alias("third"), F.get("cols", F.lit(3)).alias("fourth")
    )


@query(
    "level_names",
    with_ctes(V.EVENTS_LOG_SQL, f"SELECT {_LEVEL_NAME} AS name, count(*) AS rows FROM log GROUP BY 1"),
)
def level_names(spark: SparkSession, sf: str) -> DataFrame:
    return V.events_log(spark, sf).groupBy(level_name(F.col("level")).alias("name")).agg(F.count("*").alias("rows"))
