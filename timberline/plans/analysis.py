"""Queries over the given tables seen as logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import functions as fn
from timberline import operators as op
from timberline.formats import parse_logs
from timberline.functions.codes import TOKEN_PATTERN
from timberline.operators.error_tables import CODES_FILE
from timberline.plans import views as V
from timberline.plans.catalogue import query, with_ctes
from timberline.plans.parsing import NOW, keyword_level_sql
from timberline.sinks import to_csv_lines, to_json_records

E, O, LI, D = V.EVENTS_LOG_SQL, V.ORDERS_LOG_SQL, V.LINEITEM_LOG_SQL, V.DOCUMENT_LINES_SQL
_DISPLAY = "(['Unknown', 'Debug', 'Info', 'Notice', 'Warning', 'Error', 'Critical'])[level + 2]"
SHORT_LEVEL_SQL = "(['???', 'DBG', 'INFO', 'NOT', 'WARN', 'ERR', 'CRT'])[level + 2]"


def ts_us() -> Column:
    return F.unix_micros("timestamp").alias("ts_us")


# ---------------------------------------------------------------- flagship


def histogram_sql(source: str, buckets: int) -> str:
    """CTEs ``bars`` and ``span`` over a CTE with ``ts_us`` and ``level``."""
    return f"""
span AS (SELECT min(ts_us) AS f, max(ts_us) - min(ts_us) AS w FROM {source}),
counted AS (
  SELECT CAST(least({buckets} - 1, (ts_us - f) * {buckets} // w) AS INTEGER) AS bucket,
         count(*) FILTER (level >= 4) AS err, count(*) FILTER (level = 3) AS warn,
         count(*) FILTER (level < 3) AS info
  FROM {source}, span WHERE ts_us IS NOT NULL GROUP BY 1),
bars AS (
  SELECT CAST(b AS INTEGER) AS bucket, f + (b * w + {buckets - 1}) // {buckets} AS start_us,
         f + ((b + 1) * w + {buckets - 1}) // {buckets} AS end_us,
         coalesce(err, 0) AS err, coalesce(warn, 0) AS warn, coalesce(info, 0) AS info,
         coalesce(err, 0) + coalesce(warn, 0) + coalesce(info, 0) AS total
  FROM range(0, {buckets}) r(b) CROSS JOIN span LEFT JOIN counted ON bucket = b)"""


FLAGSHIP_SQL = with_ctes(
    E,
    "sev AS (SELECT ts_us, level FROM log WHERE level >= 3)",
    histogram_sql("sev", 60),
    "SELECT * FROM bars",
)


@query("flagship", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """ISO log lines to records, warnings and worse, as a 60-bucket histogram."""
    records = parse_logs(V.events_lines(spark, sf, "iso"), "plain", now=NOW)
    return op.histogram(op.apply_filter(records, op.LogFilter(min_level="warning")), once=True)


# ---------------------------------------------------------------- filters

_ROW_SQL = "SELECT line_number, ts_us, level, component, message FROM log WHERE "


def _filter_query(name: str, where: str, flt: op.LogFilter) -> None:
    @query(name, with_ctes(E, _ROW_SQL + where))
    def plan(spark: SparkSession, sf: str) -> DataFrame:
        rows = op.apply_filter(V.events_log(spark, sf), flt)
        return rows.select("line_number", ts_us(), "level", "component", "message")


_filter_query("filter_levels", "level IN (3, 5)", op.LogFilter(levels={"warning", "critical"}))
_filter_query("filter_min_level", "level >= 3", op.LogFilter(min_level="warning"))
_filter_query("filter_component", "component = 'user-8'", op.LogFilter(component="user-8"))
_filter_query("filter_text_ci", "contains(lower(message), 'purchase {\"k\": 1')", op.LogFilter(text='PURCHASE {"K": 1'))
_filter_query("filter_text_cs", "contains(message, 'k\": 7')", op.LogFilter(text='k": 7', case_sensitive=True))
_filter_query(
    "filter_regex", r"""regexp_matches(message, '^(view|click) .*"K": [1-4]\d\}', 'i')""",
    op.LogFilter(text=r'^(view|click) .*"K": [1-4]\d\}', regex=True),
)
_filter_query(
    "filter_time_range", "timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'",
    op.LogFilter(start=datetime(2024, 1, 10), end=datetime(2024, 1, 12)),
)
_filter_query(
    "filter_hidden_sources", "source_id NOT IN ('click', 'view')", op.LogFilter(hidden_sources={"click", "view"})
)
_filter_query(
    "filter_combined",
    "level >= 2 AND level <> 4 AND source_id <> 'signup' AND timestamp <= TIMESTAMP '2024-01-20' "
    "AND contains(lower(message), '\"k\": 5')",
    op.LogFilter(
        text='"K": 5', min_level="notice", levels=op.filters.ALL_LEVELS - {4}, hidden_sources={"signup"},
        end=datetime(2024, 1, 20),
    ),
)

PRESETS = [
    op.FilterPreset("only errors", levels=frozenset({4, 5})),
    op.FilterPreset("views of 7", text='view {"k": 7}'),
    op.FilterPreset("user 3", component="user-3"),
    op.FilterPreset("small k", text=r'"k": \d\}', regex=True),
    op.FilterPreset("shouting", text="ERROR", case_sensitive=True),
    op.FilterPreset("broken", text="(", regex=True),
]


@query(
    "filter_presets",
    with_ctes(
        E,
        r"""
SELECT p.preset, CASE p.preset
    WHEN 'only errors' THEN a WHEN 'views of 7' THEN b WHEN 'user 3' THEN c WHEN 'small k' THEN d ELSE 0 END AS rows
FROM (SELECT count(*) FILTER (level IN (4, 5)) AS a, count(*) FILTER (contains(message, 'view {"k": 7}')) AS b,
             count(*) FILTER (component = 'user-3') AS c, count(*) FILTER (regexp_matches(message, '"k": \d\}')) AS d
      FROM log),
     (VALUES ('only errors'), ('views of 7'), ('user 3'), ('small k'), ('shouting'), ('broken')) p(preset)""",
    ),
)
def filter_presets(spark: SparkSession, sf: str) -> DataFrame:
    return op.preset_counts(V.events_log(spark, sf), PRESETS)


@query(
    "search_documents",
    with_ctes(D, "SELECT source_id, line_number, raw_line FROM doc_lines WHERE contains(lower(raw_line), 'tion th')"),
)
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.document_lines(spark, sf).withColumn("level", F.lit(1))
    return op.apply_filter(lines, op.LogFilter(text="TION th", on="raw")).select("source_id", "line_number", "raw_line")


@query(
    "search_documents_regex",
    with_ctes(D, r"SELECT source_id, line_number, raw_line FROM doc_lines WHERE regexp_matches(raw_line, '[a-z]+ion [0-9a-f]{2,}', 'i')"),
)
def search_documents_regex(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.document_lines(spark, sf)
    flt = op.LogFilter(text=r"[a-z]+ion [0-9a-f]{2,}", regex=True, on="raw")
    return op.apply_filter(lines, flt).select("source_id", "line_number", "raw_line")


@query(
    "visible_of_total",
    with_ctes(E, "SELECT count(*) FILTER (level >= 3 AND contains(message, 'k\": 2')) AS visible, count(*) AS total FROM log"),
)
def visible_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return op.visible_of_total(V.events_log(spark, sf), op.LogFilter(min_level="warning", text='k": 2'))


# ---------------------------------------------------------------- find, marks


@query(
    "find_matches",
    with_ctes(E, "SELECT line_number, level, contains(message, '\"k\": 4') AS is_match FROM log WHERE level >= 1"),
)
def find_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = op.find(V.events_log(spark, sf), op.LogFilter(text='"k": 4', min_level="info"))
    return found.select("line_number", "level", "is_match")


@query(
    "find_next",
    with_ctes(
        E,
        """
SELECT line_number, row_number() OVER w - 1 AS match_index, count(*) OVER () AS match_count,
       coalesce(lead(line_number) OVER w, min(line_number) OVER ()) AS next_match,
       coalesce(lag(line_number) OVER w, max(line_number) OVER ()) AS previous_match
FROM log WHERE level >= 1 AND contains(message, '"k": 4') WINDOW w AS (ORDER BY entry_id)""",
    ),
)
def find_next(spark: SparkSession, sf: str) -> DataFrame:
    found = op.find(V.events_log(spark, sf), op.LogFilter(text='"k": 4', min_level="info"))
    return op.match_list(found, F.col("is_match"), keys=[]).select(
        "line_number", "match_index", "match_count", "next_match", "previous_match"
    )


RULES = [
    op.HighlightRule("off", "view", 0x0000FF, enabled=False),
    op.HighlightRule("broken", "(", 0x00FF00),
    op.HighlightRule("error", "^error", 0xFF0000),
    op.HighlightRule("small", r'"k": \d\}', 0xFFAA00),
    op.HighlightRule("browse", "view|click", 0x00AAFF),
]


@query(
    "highlight_first_match",
    with_ctes(
        E,
        r"""
SELECT line_number,
       CASE WHEN starts_with(message, 'error') THEN 'error' WHEN regexp_matches(message, '"k": \d\}') THEN 'small'
            WHEN regexp_matches(message, 'view|click') THEN 'browse' END AS highlight_rule,
       CAST(CASE WHEN starts_with(message, 'error') THEN 16711680 WHEN regexp_matches(message, '"k": \d\}') THEN 16755200
            WHEN regexp_matches(message, 'view|click') THEN 43775 END AS INTEGER) AS highlight_color
FROM log""",
    ),
)
def highlight_first_match(spark: SparkSession, sf: str) -> DataFrame:
    lit = op.highlight(V.events_log(spark, sf), RULES)
    return lit.select("line_number", "highlight_rule", "highlight_color")


_BOOKMARKS_SQL = """
marks AS (SELECT source_id, line_number FROM log WHERE (value > 100) <> (level >= 3))"""


def _bookmarks(log: DataFrame) -> DataFrame:
    return op.toggle_bookmarks(log.where("value > 100"), log.where("level >= 3"))


@query(
    "bookmarks_by_source",
    with_ctes(
        E,
        _BOOKMARKS_SQL,
        """
SELECT source_id, line_number, row_number() OVER (PARTITION BY source_id ORDER BY line_number) AS position,
       count(*) OVER (PARTITION BY source_id) AS total FROM marks""",
    ),
)
def bookmarks_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return op.bookmarks_by_source(_bookmarks(V.events_log(spark, sf)))


@query(
    "bookmarked_rows",
    with_ctes(E, _BOOKMARKS_SQL, "SELECT line_number, message FROM log SEMI JOIN marks USING (source_id, line_number)"),
)
def bookmarked_rows(spark: SparkSession, sf: str) -> DataFrame:
    log = V.events_log(spark, sf)
    return op.bookmarked(log, _bookmarks(log)).select("line_number", "message")


# ---------------------------------------------------------------- summaries


@query(
    "level_counts",
    with_ctes(
        E,
        """
SELECT CAST(l AS INTEGER) AS level, (['Unknown', 'Debug', 'Info', 'Notice', 'Warning', 'Error', 'Critical'])[l + 2] AS name,
       count(entry_id) AS rows
FROM range(-1, 6) r(l) LEFT JOIN log ON level = l GROUP BY l""",
    ),
)
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op.level_counts(V.events_log(spark, sf))


@query(
    "level_counts_by_component",
    with_ctes(E, "SELECT component, level, count(*) AS rows FROM log GROUP BY ALL"),
)
def level_counts_by_component(spark: SparkSession, sf: str) -> DataFrame:
    return op.level_counts_by(V.events_log(spark, sf), "component")


@query(
    "column_flags",
    "SELECT count(ts) > 0 AS has_timestamps, count(user_id) > 0 AS has_components FROM events",
)
def column_flags(spark: SparkSession, sf: str) -> DataFrame:
    return op.column_flags(V.events_log(spark, sf))


_DICTIONARY_SQL = """
dict AS (SELECT row_number() OVER (ORDER BY first_row) AS component_id, component, first_row, rows
         FROM (SELECT component, min(entry_id) AS first_row, count(*) AS rows FROM log GROUP BY 1))"""


@query("component_dictionary", with_ctes(E, _DICTIONARY_SQL, "SELECT * FROM dict"))
def component_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return op.component_dictionary(V.events_log(spark, sf), keys=[])


@query(
    "component_dictionary_capped",
    with_ctes(
        O,
        """
found AS (SELECT component, min(entry_id) AS first_row FROM orders_log GROUP BY 1),
dict AS (SELECT row_number() OVER (ORDER BY first_row) AS component_id, component FROM found QUALIFY component_id <= 100)""",
        "SELECT line_number, coalesce(component_id, 0) AS component_id FROM orders_log LEFT JOIN dict USING (component)",
    ),
)
def component_dictionary_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Components first seen after the cap become 0, as a fixed-width id column needs."""
    log = V.orders_log(spark, sf)
    ids = op.component_dictionary(log, cap=100, keys=[])
    return op.encode_components(log, ids).select("line_number", "component_id")


@query(
    "monotonicity",
    with_ctes(
        O,
        """
steps AS (SELECT message AS source_id, lag(ts_us) OVER (PARTITION BY message ORDER BY line_number) - ts_us AS step FROM orders_log)
SELECT source_id, coalesce(bool_or(step > 0), false) AS out_of_order, count(*) FILTER (step > 0) AS inversions,
       coalesce(max(step) FILTER (step > 0), 0) AS worst_us
FROM steps GROUP BY 1""",
    ),
)
def monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return op.time_inversions(V.orders_log(spark, sf).withColumn("source_id", F.col("message")))


# ---------------------------------------------------------------- histograms


@query("histogram_60", with_ctes(E, histogram_sql("log", 60), "SELECT * FROM bars"))
def histogram_60(spark: SparkSession, sf: str) -> DataFrame:
    return op.histogram(V.events_log(spark, sf))


@query("histogram_orders", with_ctes(O, histogram_sql("orders_log", 24), "SELECT * FROM bars"))
def histogram_orders(spark: SparkSession, sf: str) -> DataFrame:
    return op.histogram(V.orders_log(spark, sf), buckets=24)


@query(
    "histogram_summary",
    with_ctes(
        E,
        histogram_sql("log", 60),
        """
SELECT strftime(make_timestamp(f), '%b %-d %H:%M') AS start_label, strftime(make_timestamp(f + w), '%b %-d %H:%M') AS end_label,
       f AS first_us, w / 60.0::DOUBLE AS bucket_us, (SELECT max(total) FROM bars) AS max_total
FROM span""",
    ),
)
def histogram_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.histogram_summary(V.events_log(spark, sf))


_SPIKES_SQL = """
spikes AS (SELECT f + (2 * bucket + 1) * w // (2 * {n}) AS peak_us, total AS peak_count
           FROM bars, span, (SELECT median(total) AS m FROM bars WHERE total > 0)
           WHERE total > greatest(5, {k} * m))"""


@query("spikes", with_ctes(O, histogram_sql("orders_log", 60), _SPIKES_SQL.format(n=60, k=1.02), "SELECT * FROM spikes"))
def spikes(spark: SparkSession, sf: str) -> DataFrame:
    """A low multiplier, as order dates are spread evenly."""
    return op.spikes(op.histogram(V.orders_log(spark, sf)), multiplier=1.02)


@query(
    "spike_shadows",
    with_ctes(
        O,
        """
w0 AS (SELECT min(ts_us) AS f, max(ts_us) - min(ts_us) AS w FROM orders_log),
c20 AS (SELECT least(19, (ts_us - f) * 20 // w) AS bucket, count(*) AS total FROM orders_log, w0 GROUP BY 1),
c60 AS (SELECT least(59, (ts_us - f) * 60 // w) AS bucket, count(*) AS total FROM orders_log, w0 GROUP BY 1),
peaks AS (SELECT f + (2 * bucket + 1) * w // 40 AS peak_us, total AS peak_count
          FROM c20, w0, (SELECT median(total) AS m FROM c20) WHERE total > greatest(5, 0.9 * m)),
kept AS (SELECT * FROM peaks ORDER BY peak_count DESC, peak_us LIMIT 100),
tallest AS (SELECT (peak_us - f) * 60 // w AS bucket, max(peak_count) AS peak_count FROM kept, w0 GROUP BY 1)""",
        "SELECT CAST(bucket AS INTEGER) AS bucket, peak_count FROM tallest JOIN c60 USING (bucket) WHERE peak_count > total",
    ),
)
def spike_shadows(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks seen when the log was shown in 20 buckets, shadowed behind 60."""
    log = V.orders_log(spark, sf)
    peaks = op.retain_peaks(op.spikes(op.histogram(log, 20), multiplier=0.9), 100)
    return op.peak_shadows(op.histogram(log), peaks)


@query(
    "bucket_representative",
    with_ctes(
        O,
        histogram_sql("orders_log", 60),
        """
placed AS (SELECT *, least(59, (ts_us - f) * 60 // w) AS b, component LIKE '%7' AS shown FROM orders_log, span),
found AS (SELECT b, min(entry_id) FILTER (shown AND level >= 4) AS e, min(entry_id) FILTER (shown AND level = 3) AS wn,
                 min(entry_id) FILTER (shown) AS a FROM placed GROUP BY b),
ahead AS (SELECT bucket, (SELECT min(a) FROM found WHERE b >= bucket) AS nxt FROM bars)
SELECT bucket, coalesce(e, wn, nxt) AS target,
       coalesce(e, wn) IS NULL AND (SELECT min(b) FROM found WHERE a = nxt AND b >= bucket) > bucket AS rolled
FROM ahead LEFT JOIN found ON b = bucket WHERE coalesce(e, wn, nxt) IS NOT NULL""",
    ),
)
def bucket_representative(spark: SparkSession, sf: str) -> DataFrame:
    return op.bucket_representatives(V.orders_log(spark, sf), visible=F.col("component").endswith("7"), keys=[])


def _us(text: str) -> int:
    moment = datetime.fromisoformat(text)
    return int((moment - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


RANGES = [(_us(a), _us(b)) for a, b in [("1995-06-01", "1995-07-01"), ("1998-01-01", "1998-01-02"), ("2010-01-01", "2011-01-01")]]


@query(
    "first_in_range",
    with_ctes(
        O,
        f"""
SELECT CAST(i AS INTEGER) AS range_id, CAST(a AS BIGINT) AS start_us, CAST(b AS BIGINT) AS end_us,
       (SELECT min(entry_id) FROM orders_log WHERE ts_us >= a AND ts_us < b AND level IN (3, 4)) AS first_row
FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(RANGES))}) v(i, a, b)""",
    ),
)
def first_in_range(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_in_ranges(V.orders_log(spark, sf), RANGES, levels=[3, 4], keys=[])


# ---------------------------------------------------------------- order and navigation


@query(
    "time_order",
    with_ctes(
        O,
        "SELECT line_number, ts_us, row_number() OVER (ORDER BY ts_us, entry_id) - 1 AS position FROM orders_log",
    ),
)
def time_order(spark: SparkSession, sf: str) -> DataFrame:
    log = V.orders_log(spark, sf)
    by_time = [F.col("timestamp").asc_nulls_first(), F.col("entry_id")]
    return op.number_sorted(log, by_time, "position", 0, "time-order").select("line_number", ts_us(), "position")


TARGETS = [_us(t) for t in ("1990-01-01", "1995-03-01", "1998-10-03T12:00:00", "2030-01-01")]


@query(
    "nearest_before",
    with_ctes(
        O,
        f"""
SELECT CAST(t AS BIGINT) AS target_us,
       coalesce((SELECT max_by(entry_id, (ts_us, entry_id)) FROM orders_log WHERE ts_us <= t), (SELECT min(entry_id) FROM orders_log)) AS row
FROM (VALUES {', '.join(f'({t})' for t in TARGETS)}) v(t)""",
    ),
)
def nearest_before(spark: SparkSession, sf: str) -> DataFrame:
    return op.nearest_rows(V.orders_log(spark, sf), TARGETS, keys=[])


@query(
    "next_error",
    with_ctes(
        E,
        """
SELECT line_number,
       min(CASE WHEN level >= 4 THEN line_number END) OVER (ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error,
       max(CASE WHEN level >= 4 THEN line_number END) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_error
FROM log""",
    ),
)
def next_error(spark: SparkSession, sf: str) -> DataFrame:
    return op.neighbouring_errors(V.events_log(spark, sf), keys=[]).select("line_number", "next_error", "previous_error")


@query(
    "line_position",
    with_ctes(
        E,
        """
SELECT line_number, CASE WHEN level >= 3 THEN count(*) FILTER (level >= 3) OVER (ORDER BY entry_id) - 1 END AS position
FROM log""",
    ),
)
def line_position(spark: SparkSession, sf: str) -> DataFrame:
    return op.visible_position(V.events_log(spark, sf), F.col("level") >= 3, keys=[]).select("line_number", "position")


# ---------------------------------------------------------------- navigation in many files


_FILES = V.CUSTOMER_LOGS_SQL


@query(
    "find_next_files",
    with_ctes(
        _FILES,
        """
SELECT source_id, line_number, row_number() OVER w - 1 AS match_index, count(*) OVER p AS match_count,
       coalesce(lead(line_number) OVER w, min(line_number) OVER p) AS next_match,
       coalesce(lag(line_number) OVER w, max(line_number) OVER p) AS previous_match
FROM files WHERE level >= 3 WINDOW w AS (PARTITION BY source_id ORDER BY entry_id), p AS (PARTITION BY source_id)""",
    ),
)
def find_next_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.match_list(V.customer_logs(spark, sf), F.col("level") >= 3).select(
        "source_id", "line_number", "match_index", "match_count", "next_match", "previous_match"
    )


@query(
    "next_error_files",
    with_ctes(
        _FILES,
        """
SELECT source_id, line_number,
       min(line_number) FILTER (level >= 4) OVER (PARTITION BY source_id ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error,
       max(line_number) FILTER (level >= 4) OVER (PARTITION BY source_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_error
FROM files""",
    ),
)
def next_error_files(spark: SparkSession, sf: str) -> DataFrame:
    found = op.neighbouring_errors(V.customer_logs(spark, sf))
    return found.select("source_id", "line_number", "next_error", "previous_error")


@query(
    "line_position_files",
    with_ctes(
        _FILES,
        """
SELECT source_id, line_number,
       CASE WHEN level >= 3 THEN count(*) FILTER (level >= 3) OVER (PARTITION BY source_id ORDER BY entry_id) - 1 END AS position
FROM files""",
    ),
)
def line_position_files(spark: SparkSession, sf: str) -> DataFrame:
    placed = op.visible_position(V.customer_logs(spark, sf), F.col("level") >= 3)
    return placed.select("source_id", "line_number", "position")


@query(
    "first_in_range_files",
    with_ctes(
        _FILES,
        f"""
SELECT source_id, CAST(i AS INTEGER) AS range_id, CAST(a AS BIGINT) AS start_us, CAST(b AS BIGINT) AS end_us,
       min(entry_id) FILTER (ts_us >= a AND ts_us < b) AS first_row
FROM (SELECT * FROM files WHERE level IN (3, 4)) CROSS JOIN (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(RANGES))}) v(i, a, b)
GROUP BY ALL""",
    ),
)
def first_in_range_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_in_ranges(V.customer_logs(spark, sf), RANGES, levels=[3, 4])


@query(
    "nearest_before_files",
    with_ctes(
        _FILES,
        f"""
SELECT source_id, CAST(t AS BIGINT) AS target_us,
       coalesce(max_by(entry_id, (ts_us, entry_id)) FILTER (ts_us <= t), min(entry_id)) AS row
FROM files CROSS JOIN (VALUES {', '.join(f'({t})' for t in TARGETS)}) v(t) GROUP BY ALL""",
    ),
)
def nearest_before_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.nearest_rows(V.customer_logs(spark, sf), TARGETS)


@query(
    "bucket_representative_files",
    with_ctes(
        _FILES,
        histogram_sql("files", 60),
        """
placed AS (SELECT *, least(59, (ts_us - f) * 60 // w) AS b, component LIKE '%7' AS shown, (source_id, entry_id) AS r FROM files, span),
found AS (SELECT b, min(r) FILTER (shown AND level >= 4) AS e, min(r) FILTER (shown AND level = 3) AS wn,
                 min(r) FILTER (shown) AS a FROM placed GROUP BY b),
ahead AS (SELECT bucket, (SELECT min(a) FROM found WHERE b >= bucket) AS nxt FROM bars),
chosen AS (SELECT bucket, coalesce(e, wn, nxt) AS r,
       coalesce(e, wn) IS NULL AND (SELECT min(b) FROM found WHERE a = nxt AND b >= bucket) > bucket AS rolled
  FROM ahead LEFT JOIN found ON b = bucket)
SELECT bucket, r[1] AS source_id, r[2] AS target, rolled FROM chosen WHERE r IS NOT NULL""",
    ),
)
def bucket_representative_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.bucket_representatives(V.customer_logs(spark, sf), visible=F.col("component").endswith("7"))


@query(
    "component_dictionary_files",
    with_ctes(
        _FILES,
        """
firsts AS (SELECT split_part(message, ' ', 3) AS component, min((source_id, entry_id)) AS r, count(*) AS rows FROM files GROUP BY 1)
SELECT row_number() OVER (ORDER BY r, component) AS component_id, component, r[1] AS source_id, r[2] AS first_row, rows FROM firsts""",
    ),
)
def component_dictionary_files(spark: SparkSession, sf: str) -> DataFrame:
    """The order's priority as the component, numbered as it first appears, file by file."""
    log = V.customer_logs(spark, sf)
    return op.component_dictionary(log.withColumn("component", F.get(F.split("message", " "), F.lit(2))))


@query(
    "asof_two_logs",
    with_ctes(
        O,
        LI,
        """
marks AS (SELECT ts_us, max(entry_id) AS e FROM orders_log GROUP BY 1)
SELECT l.line_number, l.ts_us, coalesce(m.e, (SELECT min(entry_id) FROM orders_log)) AS near_entry_id,
       o.message AS near_message
FROM lineitem_log l ASOF LEFT JOIN marks m ON l.ts_us >= m.ts_us
JOIN orders_log o ON o.entry_id = coalesce(m.e, (SELECT min(entry_id) FROM orders_log))""",
    ),
)
def asof_two_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Each shipment with the last order placed at or before it."""
    left, right = V.lineitem_log(spark, sf), V.orders_log(spark, sf)
    near = op.asof_join(left.select("line_number", "timestamp"), right, ["entry_id", "message"])
    return near.select("line_number", ts_us(), "near_entry_id", "near_message")


# ---------------------------------------------------------------- merging

_MERGED_SQL = """
merged AS (
  SELECT row_number() OVER (ORDER BY ts_us, rank, line_number) AS line_number, ts_us, level, message, component,
         source_id, line_number AS source_line_number
  FROM (SELECT 0 AS rank, ts_us, line_number, level, message, component, 'events' AS source_id FROM log
        UNION ALL SELECT 1, ts_us, line_number, level, message, component, 'orders' FROM orders_log
        UNION ALL SELECT 2, ts_us, line_number, level, message, component, 'lineitem' FROM lineitem_log)
  WHERE ts_us IS NOT NULL)"""


def _three_logs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    columns = ["line_number", "timestamp", "level", "message", "component"]
    return {
        "events": V.events_log(spark, sf).select(columns),
        "orders": V.orders_log(spark, sf).select(columns),
        "lineitem": V.lineitem_log(spark, sf).select(columns),
    }


@query("merge_logs", with_ctes(E, O, LI, _MERGED_SQL, "SELECT * FROM merged"))
def merge_logs(spark: SparkSession, sf: str) -> DataFrame:
    merged = op.merge_logs(_three_logs(spark, sf))
    return merged.select("line_number", ts_us(), "level", "message", "component", "source_id", "source_line_number")


@query(
    "merge_back_to_source",
    with_ctes(
        E, O, LI, _MERGED_SQL,
        """
SELECT line_number, source_id, source_line_number AS origin_line_number, message AS origin_message FROM merged""",
    ),
)
def merge_back_to_source(spark: SparkSession, sf: str) -> DataFrame:
    logs = _three_logs(spark, sf)
    back = op.back_to_source(op.merge_logs(logs), logs)
    return back.select("line_number", "source_id", "origin_line_number", "origin_message")


@query(
    "merge_sources",
    with_ctes(E, O, "SELECT DISTINCT source_id FROM (SELECT 'events' AS source_id FROM log UNION ALL SELECT 'orders' FROM orders_log)"),
)
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    logs = _three_logs(spark, sf)
    return op.source_list(op.merge_logs({n: logs[n] for n in ("events", "orders")}))


@query(
    "histogram_merged",
    with_ctes(E, O, LI, _MERGED_SQL, histogram_sql("merged", 60), "SELECT * FROM bars"),
)
def histogram_merged(spark: SparkSession, sf: str) -> DataFrame:
    return op.histogram(op.merge_logs(_three_logs(spark, sf)))


# ---------------------------------------------------------------- error codes


# The dimension is read from its file; order and ranges of domains are stated once more.
CODES_SQL = f"""
codes AS (
  SELECT CAST(list_position(['errno', 'OSStatus', 'IOReturn', 'Mach', 'CFNetwork', 'Cocoa', 'Security', 'POSIX Signal',
                             'SQLite', 'gRPC', 'Bonjour', 'Exit Code', 'HTTP'], domain) * 1000 + row_number() OVER () AS BIGINT) AS rnk,
         domain, code, symbol,
         CASE domain WHEN 'gRPC' THEN code BETWEEN 0 AND 16 WHEN 'Exit Code' THEN code BETWEEN 0 AND 255
              WHEN 'HTTP' THEN code BETWEEN 1 AND 599 ELSE true END AS numbered
  FROM read_csv('{CODES_FILE}', header = true, quote = '"',
                columns = {{'domain': 'VARCHAR', 'code': 'INTEGER', 'symbol': 'VARCHAR', 'description': 'VARCHAR'}})
)"""

_NUMBER_SQL = """CASE WHEN regexp_full_match({t}, '0[xX][0-9A-Fa-f]+') THEN
      CASE WHEN TRY_CAST(concat('0x', {t}[3:]) AS BIGINT) BETWEEN 2147483648 AND 4294967295
           THEN TRY_CAST(concat('0x', {t}[3:]) AS BIGINT) - 4294967296 ELSE TRY_CAST(concat('0x', {t}[3:]) AS BIGINT) END
      ELSE TRY_CAST({t} AS BIGINT) END"""

_HEX_SQL = """CASE WHEN domain IN ('HTTP', 'gRPC') THEN NULL
      WHEN domain = 'IOReturn' THEN '0x' || upper(lpad(to_hex(code & 4294967295), 8, '0'))
      ELSE '0x' || upper(to_hex(code & 4294967295)) END"""

_PREFERRED_SQL = """CASE WHEN starts_with(t, 'errSec') THEN 'Security' WHEN upper(t) LIKE 'SIG%' THEN 'POSIX Signal'
      WHEN starts_with(upper(t), 'SQLITE_') THEN 'SQLite' WHEN starts_with(upper(t), 'KDNSSERVICEERR_') THEN 'Bonjour'
      WHEN upper(t) LIKE 'NSURL%' OR upper(t) LIKE 'KCFERROR%' THEN 'CFNetwork' WHEN starts_with(upper(t), 'EX_') THEN 'Exit Code'
      WHEN regexp_full_match(upper(t), 'E[A-Z]+') THEN 'errno'
      WHEN regexp_full_match(t, '0[xX]8[0-9A-Fa-f]{7}') THEN 'OSStatus'
      WHEN t ILIKE '0x%' AND n BETWEEN -536870400 AND -536870145 THEN 'IOReturn'
      WHEN t NOT ILIKE '0x%' AND n BETWEEN 100 AND 599 THEN 'HTTP'
      WHEN t NOT ILIKE '0x%' AND n BETWEEN -3010 AND -1 THEN 'CFNetwork' END"""


@query(
    "error_lookup",
    with_ctes(
        V.CODE_INPUTS_SQL,
        CODES_SQL,
        f"""
inputs AS (SELECT DISTINCT t, {_NUMBER_SQL.format(t='t')} AS n FROM asked),
pref AS (SELECT *, {_PREFERRED_SQL} AS p FROM inputs),
found AS (SELECT t, domain, code, symbol,
                 CAST(row_number() OVER (PARTITION BY t ORDER BY coalesce(domain <> p, false), rnk) AS INTEGER) AS match_rank
          FROM pref JOIN codes ON (n = code AND numbered) OR (n IS NULL AND upper(t) = upper(symbol) AND domain <> 'HTTP'))
SELECT entry_id, t AS input, match_rank, domain, code, symbol, {_HEX_SQL} AS hex
FROM (SELECT entry_id, t FROM asked) JOIN found USING (t)""",
    ),
)
def error_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.code_inputs(spark, sf).select("entry_id", "input")
    return op.error_lookup(asked, "input").drop("description")


@query(
    "error_lookup_domain",
    with_ctes(
        V.CODE_INPUTS_SQL,
        CODES_SQL,
        f"""
inputs AS (SELECT DISTINCT t, domain, {_NUMBER_SQL.format(t='t')} AS n FROM asked),
found AS (SELECT t, i.domain, code, symbol FROM inputs i JOIN codes c ON i.domain = c.domain
          AND ((n = code AND numbered) OR (n IS NULL AND upper(t) = upper(symbol) AND c.domain <> 'HTTP')))
SELECT entry_id, t AS input, domain, code, symbol,
       CASE WHEN code IS NOT NULL THEN {_HEX_SQL} END AS hex
FROM asked LEFT JOIN found USING (t, domain)""",
    ),
)
def error_lookup_domain(spark: SparkSession, sf: str) -> DataFrame:
    return op.error_lookup_in(V.code_inputs(spark, sf), "input", "domain").drop("description")


@query(
    "error_priority",
    with_ctes(
        V.CODE_INPUTS_SQL,
        f"""
inputs AS (SELECT DISTINCT t, {_NUMBER_SQL.format(t='t')} AS n FROM asked)
SELECT entry_id, t AS input, {_PREFERRED_SQL} AS preferred FROM asked JOIN inputs USING (t)""",
    ),
)
def error_priority(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.code_inputs(spark, sf).select("entry_id", "input")
    return asked.withColumn("preferred", op.preferred_domain(F.col("input")))


_TOKEN_RE = TOKEN_PATTERN


def _decode_sql(strict: bool) -> str:
    bare = "token" if strict else r"regexp_replace(token, '^(errno=|OSStatus\s|error\s)', '')"
    hint = (
        "CAST(NULL AS VARCHAR)"
        if strict
        else "CASE WHEN starts_with(token, 'errno=') THEN 'errno' WHEN starts_with(token, 'OSStatus') THEN 'OSStatus' END"
    )
    return with_ctes(
        V.CODE_MESSAGES_SQL,
        CODES_SQL,
        f"""
texts AS (SELECT DISTINCT m, regexp_extract_all(m, '{_TOKEN_RE}', 1) AS ts FROM said),
tokens AS (SELECT m, i, token, {bare} AS t, {hint} AS hint
           FROM (SELECT m, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS token FROM texts)),
numbers AS (SELECT *, {_NUMBER_SQL.format(t='t')} AS n FROM tokens),
pref AS (SELECT *, {_PREFERRED_SQL} AS p FROM numbers),
found AS (SELECT m, i, token, domain, code, symbol, row_number() OVER (PARTITION BY m, i ORDER BY coalesce(domain <> p, false), rnk) AS r
          FROM pref JOIN codes ON (hint IS NULL OR hint = domain)
           AND ((n = code AND numbered) OR (n IS NULL AND upper(t) = upper(symbol) AND domain <> 'HTTP'))),
best AS (SELECT m, min(i) AS i FROM found GROUP BY m)
SELECT entry_id, m AS message, token AS code_token, domain, code, symbol,
       CAST(coalesce((SELECT count(*) FROM found g WHERE g.m = s.m AND g.i = b.i), 0) AS INTEGER) AS found
FROM said s LEFT JOIN best b USING (m) LEFT JOIN found f ON f.m = s.m AND f.i = b.i AND f.r = 1""",
    )


def _decode(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    decoded = op.decode_codes(V.code_messages(spark, sf), strict=strict)
    best = F.get("matches", F.lit(0))
    return decoded.select(
        "entry_id", "message", "code_token", best["domain"].alias("domain"), best["code"].alias("code"),
        best["symbol"].alias("symbol"), F.coalesce(F.size("matches"), F.lit(0)).alias("found"),
    )


@query("decode_message_codes", _decode_sql(False))
def decode_message_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _decode(spark, sf, strict=False)


@query("decode_message_codes_strict", _decode_sql(True))
def decode_message_codes_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _decode(spark, sf, strict=True)


# ---------------------------------------------------------------- export and display


@query(
    "export_csv_lines",
    with_ctes(
        E,
        f"""
SELECT line_number, line_number || ',"' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '",' || {SHORT_LEVEL_SQL} || ',"' ||
       component || '","' || replace(message, '"', '""') || '"' AS value FROM log""",
    ),
)
def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return to_csv_lines(V.events_log(spark, sf)).select("line_number", "value")


@query(
    "export_json_records",
    with_ctes(
        E,
        f"""
SELECT line_number, '{{' || CASE WHEN entry_id % 2 = 0 THEN '"component":"' || component || '",' ELSE '' END ||
       '"level":"' || {_DISPLAY} || '","line":' || line_number || ',"message":"' || replace(message, '"', '\\"') ||
       '","timestamp":"' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '"}}' AS value FROM log""",
    ),
)
def export_json_records(spark: SparkSession, sf: str) -> DataFrame:
    log = V.events_log(spark, sf).withColumn("component", F.when(F.col("entry_id") % 2 == 0, F.col("component")))
    return to_json_records(log).select("line_number", "value")


@query(
    "format_columns",
    with_ctes(
        E,
        f"""
sized AS (SELECT *, entry_id * entry_id * 37 AS size FROM log)
SELECT line_number, strftime(timestamp, '%H:%M:%S.%g') AS clock, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS moment,
       format('{{:,}}', size) AS grouped,
       CASE WHEN size < 1000 THEN size::VARCHAR WHEN size < 10000 THEN replace(format('{{:.1f}}k', size / 1000.0), '.0k', 'k')
            ELSE (size // 1000)::VARCHAR || 'k' END AS compact,
       {SHORT_LEVEL_SQL} AS short, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' · ' || component || ' · thread ' || entry_id || ' · ' || {_DISPLAY} AS about
FROM sized""",
    ),
)
def format_columns(spark: SparkSession, sf: str) -> DataFrame:
    log, size = V.events_log(spark, sf), F.col("entry_id") * F.col("entry_id") * 37
    ts, level = F.col("timestamp"), F.col("level")
    return log.select(
        "line_number",
        fn.format_clock(ts).alias("clock"),
        fn.format_datetime(ts).alias("moment"),
        fn.format_count(size).alias("grouped"),
        fn.compact_count(size).alias("compact"),
        fn.level_short(level).alias("short"),
        fn.metadata_line(ts, F.col("component"), F.col("entry_id").cast("string"), level).alias("about"),
    )


@query(
    "format_document_sizes",
    """
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 102400 THEN format('{:.1f} KB', b / 1024.0)
       WHEN b < 1048576 THEN format('{:.0f} KB', b / 1024.0) ELSE format('{:.1f} MB', b / 1048576.0) END AS size
FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)""",
)
def format_document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", fn.format_bytes(F.octet_length("text")).alias("size"))


@query(
    "page_basenames",
    r"SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS name FROM pages",
)
def page_basenames(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").select("page_id", fn.basename(F.col("url")).alias("name"))


@query(
    "conversation_levels",
    f"SELECT level, role, count(*) AS turns FROM (SELECT role, {keyword_level_sql('text')} AS level FROM conversations) GROUP BY ALL",
)
def conversation_levels(spark: SparkSession, sf: str) -> DataFrame:
    turns = V.table(spark, sf, "conversations")
    return turns.groupBy(fn.detect_level(F.col("text")).alias("level"), "role").agg(F.count("*").alias("turns"))


# ---------------------------------------------------------------- rates and pauses

# A month of events squeezed 300-fold, to about one line per second.
_SQUEEZE = 300


@query(
    "rate_ewma",
    with_ctes(
        E,
        f"""
counts AS (SELECT (ts_us // {_SQUEEZE}) // 1000000 AS second, count(*) AS lines FROM log GROUP BY 1),
steps AS (SELECT second, lines, row_number() OVER (ORDER BY second) AS i, second - lag(second) OVER (ORDER BY second) AS gap FROM counts),
rated AS (SELECT i, second, CAST(0.4 AS DOUBLE) * lines AS rate FROM steps WHERE i = 1
          UNION ALL SELECT s.i, s.second, r.rate * pow(0.6, s.gap) + CAST(0.4 AS DOUBLE) * s.lines FROM rated r JOIN steps s ON s.i = r.i + 1)
SELECT second, lines, round(rate, 6) AS rate, coalesce(second - lag(second) OVER (ORDER BY second) - 1, 0) AS idle_before,
       coalesce(second - lag(second) OVER (ORDER BY second) - 1, 0) >= 5 AS stalled_before
FROM counts JOIN rated USING (second)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rate_ewma(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros("timestamp")
    squeezed = F.timestamp_micros(F.call_function("div", us, F.lit(_SQUEEZE).cast("long")))
    log = V.events_log(spark, sf).select(squeezed.alias("timestamp"))
    return op.line_rates(log).withColumn("rate", F.round("rate", 6))


@query(
    "rate_seconds",
    with_ctes(
        E,
        f"""
counts AS (SELECT (ts_us // {_SQUEEZE}) // 1000000 AS second, count(*) AS lines FROM log GROUP BY 1),
every AS (SELECT unnest(generate_series(min(second), max(second) + 7)) AS second FROM counts),
steps AS (SELECT second, coalesce(lines, 0) AS lines, row_number() OVER (ORDER BY second) AS i FROM every LEFT JOIN counts USING (second)),
rated AS (SELECT i, second, lines, CAST(0.4 AS DOUBLE) * lines AS rate, CAST(0 AS BIGINT) AS idle_seconds FROM steps WHERE i = 1
          UNION ALL SELECT s.i, s.second, s.lines, CAST(0.6 AS DOUBLE) * r.rate + CAST(0.4 AS DOUBLE) * s.lines, CASE WHEN s.lines > 0 THEN 0 ELSE r.idle_seconds + 1 END
          FROM rated r JOIN steps s ON s.i = r.i + 1)
SELECT second, lines, round(rate, 6) AS rate, idle_seconds, idle_seconds >= 5 AS stalled FROM rated""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rate_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Every second with its rate, idle ones too, and seven more after the last line."""
    squeezed = F.timestamp_micros(F.call_function("div", F.unix_micros("timestamp"), F.lit(_SQUEEZE).cast("long")))
    log = V.events_log(spark, sf).select(squeezed.alias("timestamp"))
    until = log.agg(F.max("timestamp") + F.expr("INTERVAL 7 SECONDS")).scalar()
    return op.rate_seconds(log, until=until).withColumn("rate", F.round("rate", 6))


_PAUSE_SQL = """
ctl AS (SELECT *, event_type = 'signup' AS pause, event_type = 'purchase' AS resume FROM log),
st AS (SELECT *, last_value(CASE WHEN pause THEN 1 WHEN resume THEN 0 END IGNORE NULLS) OVER w AS s,
              coalesce(count(*) FILTER (resume) OVER w, 0) AS resumes
       FROM ctl WINDOW w AS (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lines AS (SELECT *, coalesce(s = 1, false) AS paused, CASE WHEN s = 1 THEN resumes END AS pause_id FROM st
          WHERE NOT pause AND NOT resume),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pause_id ORDER BY entry_id DESC) AS back FROM lines)"""


def _paused_lines(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    state = op.pause_state(V.events_log(spark, sf), "entry_id", kind == "signup", kind == "purchase")
    return state.where(~kind.isin("signup", "purchase"))


@query(
    "pause_buffer",
    with_ctes(
        E, _PAUSE_SQL,
        """
SELECT line_number, paused, pause_id, row_number() OVER (ORDER BY entry_id) AS live_number
FROM ranked WHERE NOT paused OR back <= 2""",
    ),
)
def pause_buffer(spark: SparkSession, sf: str) -> DataFrame:
    kept = op.pause_buffer(_paused_lines(spark, sf), "entry_id", capacity=2)
    return kept.select("line_number", "paused", "pause_id", "live_number")


@query(
    "pause_drops",
    with_ctes(
        E, _PAUSE_SQL,
        """
SELECT pause_id, least(count(*), 2) AS buffered, greatest(count(*) - 2, 0) AS dropped
FROM ranked WHERE paused GROUP BY 1""",
    ),
)
def pause_drops(spark: SparkSession, sf: str) -> DataFrame:
    return op.pause_drops(_paused_lines(spark, sf), capacity=2)


@query(
    "arrival_numbers",
    with_ctes(
        E,
        "SELECT entry_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY entry_id) AS live_number FROM log",
    ),
)
def arrival_numbers(spark: SparkSession, sf: str) -> DataFrame:
    numbered = op.number_rows(V.events_log(spark, sf), "entry_id", "live_number", keys=["source_id"])
    return numbered.select("entry_id", "source_id", "live_number")
