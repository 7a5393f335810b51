"""The given tables seen as logs, and the same rows rendered as lines of each format.

Every view has a twin in SQL (``*_SQL``) for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.display import level_name
from timberline.operators.ordered import number_rows, number_sorted
from timberline.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; times without a zone are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})


def event_level() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", 0)
        .when(kind == "view", 1)
        .when(kind == "signup", 2)
        .when(kind == "purchase", 3)
        .when((kind == "error") & (F.col("value") > 200), 5)
        .when(kind == "error", 4)
        .otherwise(-1)
    )


def as_events_log(events: DataFrame) -> DataFrame:
    """Events as log records: the type sets the level, the user is the component."""
    return events.select(
        F.col("event_id").alias("entry_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.col("ts").alias("timestamp"),
        event_level().alias("level"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("component"),
        F.col("event_type").alias("source_id"),
        "event_type",
        "props",
        "value",
        "user_id",
    )


EVENTS_LOG_SQL = """
log AS (
  SELECT event_id AS entry_id, event_id + 1 AS line_number, ts AS timestamp,
         epoch_us(ts) AS ts_us,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2
              WHEN 'purchase' THEN 3
              WHEN 'error' THEN CASE WHEN value > 200 THEN 5 ELSE 4 END ELSE -1 END AS INTEGER) AS level,
         event_type || ' ' || props AS message, 'user-' || user_id AS component,
         event_type AS source_id, event_type, props, value, user_id
  FROM events
)"""


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_events_log(table(spark, sf, "events"))


def orders_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_orders_log(table(spark, sf, "orders"))


def as_orders_log(orders: DataFrame) -> DataFrame:
    """Orders by key: dates at midnight, so out of order and with many equal times."""
    return orders.select(
        F.col("o_orderkey").alias("entry_id"),
        (F.col("o_orderkey") + 1).alias("line_number"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderpriority").startswith("1"), 4)
        .when(F.col("o_orderpriority").startswith("2"), 3)
        .otherwise(1)
        .alias("level"),
        F.concat_ws(" ", F.lit("order"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("message"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("component"),
        F.lit("orders").alias("source_id"),
    )


ORDERS_LOG_SQL = """
orders_log AS (
  SELECT o_orderkey AS entry_id, o_orderkey + 1 AS line_number, o_orderdate AS timestamp,
         epoch_us(o_orderdate) AS ts_us,
         CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 4 WHEN o_orderpriority LIKE '2%' THEN 3 ELSE 1 END AS INTEGER) AS level,
         'order ' || o_orderstatus || ' ' || o_orderpriority AS message,
         'customer-' || o_custkey AS component, 'orders' AS source_id
  FROM orders
)"""

_LINEITEM_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def lineitem_log(spark: SparkSession, sf: str) -> DataFrame:
    """Line items, whose keys repeat, numbered by all their columns."""
    items = table(spark, sf, "lineitem")
    numbered = number_sorted(items, [F.col(c) for c in _LINEITEM_ORDER], "entry_id", 0, "lineitem")
    return numbered.select(
        "entry_id",
        (F.col("entry_id") + 1).alias("line_number"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", 3).otherwise(1).alias("level"),
        F.concat_ws(" ", F.lit("shipped"), F.col("l_returnflag"), F.col("l_linestatus")).alias("message"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("component"),
        F.lit("lineitem").alias("source_id"),
    )


LINEITEM_LOG_SQL = f"""
lineitem_log AS (
  SELECT row_number() OVER (ORDER BY {', '.join(_LINEITEM_ORDER)}) - 1 AS entry_id,
         row_number() OVER (ORDER BY {', '.join(_LINEITEM_ORDER)}) AS line_number,
         l_shipdate AS timestamp, epoch_us(l_shipdate) AS ts_us,
         CAST(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END AS INTEGER) AS level,
         'shipped ' || l_returnflag || ' ' || l_linestatus AS message,
         'supplier-' || l_suppkey AS component, 'lineitem' AS source_id
  FROM lineitem
)"""


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files: their lines, numbered, without the empty ones."""
    return (
        spread(table(spark, sf, "documents"))
        .select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
            F.posexplode(F.split("text", "\r\n|\n|\r")).alias("_i", "raw_line"),
        )
        .select("source_id", (F.col("_i") + 1).cast("long").alias("line_number"), "raw_line")
        .where(F.col("raw_line") != "")
    )


DOCUMENT_LINES_SQL = r"""
doc_lines AS (
  SELECT source_id, line_number, parts[line_number] AS raw_line
  FROM (SELECT 'doc-' || doc_id AS source_id, parts, unnest(range(1, len(parts) + 1)) AS line_number
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS parts FROM documents))
  WHERE parts[line_number] <> ''
)"""


def _stamp(pattern: str) -> Column:
    return F.date_format("timestamp", pattern)


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]))


def _display_level() -> Column:
    return F.initcap(level_name(F.col("level")))


def rendered(fmt: str) -> Column:
    """An event log record as a line of ``fmt``."""
    level, component, message = level_name(F.col("level")), F.col("component"), F.col("message")
    entry = F.col("entry_id").cast("string")
    dated, iso = _stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    syslog_day = F.concat(_stamp("MMM"), F.lit(" "), F.lpad(_stamp("d"), 2, " "))

    def text(pattern: str, *parts: Column) -> Column:
        return F.format_string(pattern, *parts)

    if fmt == "dated_syslog":
        return text("%s host1 %s[%s]: %s", dated, component, entry, message)
    if fmt == "bsd_syslog":
        return text("%s %s host1 %s[%s] <%s>: %s", syslog_day, _stamp("HH:mm:ss"), component, entry, _display_level(), message)
    if fmt == "apple_daemon":
        return text("%s %s %s [%s]/0 %s", _stamp("EEE"), syslog_day, _stamp("HH:mm:ss.SSS"), component, message)
    if fmt == "bracketed":
        inside = text("[%s %s %s] %s", dated, F.upper(level), component, message)
        return F.when(F.col("entry_id") % 2 == 0, inside).otherwise(text("[%s] [%s] %s", dated, level, message))
    if fmt == "prefix_tagged":
        return text("[%s] %s [%s] net: %s", component, dated, level, message)
    if fmt == "logfmt":
        quoted = F.replace(message, F.lit('"'), F.lit('\\"'))
        return text('time="%s" level=%s msg="%s"', iso, level, quoted)
    if fmt == "dated_component":
        return text("%s %s[%s]: %s", iso, component, entry, message)
    if fmt == "iso":
        return text("%s [%s] %s: %s", iso, F.upper(level), component, message)
    if fmt == "level_prefix":
        return text("[%s] %s: %s", F.upper(level), component, message)
    if fmt == "bare_text":
        return text("  %s met %s", component, message)
    if fmt == "sccm":
        kind = F.when(F.col("level") >= 4, "3").when(F.col("level") == 3, "2").otherwise("1")
        return text(
            '<![LOG[%s]LOG]!><time="%s+060" date="%s" component="%s" context="" type="%s" thread="%s" file="%s">',
            message, _stamp("HH:mm:ss.SSS"), _stamp("MM-dd-yyyy"), component, kind, entry, F.col("source_id"),
        )
    if fmt == "json":
        plain = _json(timestamp=iso, level=level, message=message, component=component, thread=entry)
        micros = F.unix_micros("timestamp")
        millis = (micros - F.pmod(micros, F.lit(1000))) / 1000
        severity = F.when(F.col("level") == 5, "FATAL").otherwise(F.upper(level))
        cased = _json(TS=millis.cast("long"), Severity=severity, msg=message, Logger=component, tid=F.col("entry_id"))
        return F.when(F.col("entry_id") % 2 == 0, plain).otherwise(cased)
    if fmt == "unified":
        kind = (
            F.when(F.col("level") == 5, "Fault").when(F.col("level") == 4, "Error")
            .when(F.col("level") == 2, "Default").when(F.col("level") == 0, "Debug").otherwise("Info")
        )
        return F.concat(
            _json(
                timestamp=F.concat(dated, F.lit("+0000")),
                messageType=kind,
                eventMessage=message,
                processImagePath=F.concat(F.lit("/usr/libexec/"), F.col("event_type")),
                subsystem=F.when(F.col("entry_id") % 3 == 0, "").otherwise(component),
                category=F.when(F.col("entry_id") % 3 == 1, "net"),
                threadID=F.col("entry_id"),
            ),
            F.lit(","),
        )
    if fmt == "csv":
        quoted = F.replace(message, F.lit('"'), F.lit('""'))
        return text('%s,%s,%s,"%s, seen on the front page"', dated, level, component, quoted)
    raise ValueError(fmt)


def events_lines(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """The events log as lines of one format, one file."""
    lines = as_events_log(spread(table(spark, sf, "events"))).select(
        F.lit(fmt).alias("source_id"), "line_number", "entry_id", rendered(fmt).alias("raw_line")
    )
    if fmt != "csv":
        return lines
    header = spark.range(1).select(
        F.lit(fmt).alias("source_id"), F.lit(1).cast("long").alias("line_number"),
        F.lit(None).cast("long").alias("entry_id"),
        F.lit("timestamp,level,component,message").alias("raw_line"),
    )
    return header.unionByName(lines.withColumn("line_number", F.col("line_number") + 1))


def report_lines(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Each event as a report file: a crash report or a diagnostic report."""
    log = as_events_log(spread(table(spark, sf, "events")))
    dated = _stamp("yyyy-MM-dd HH:mm:ss.SSS")
    if kind == "ips":
        bug = (
            F.when(F.col("level") == 5, "110").when(F.col("level") == 4, "309")
            .when(F.col("level") == 3, "288").when(F.col("level") == 2, "298")
            .when(F.col("level") == 1, "777")
        )
        header = _json(
            timestamp=F.concat(dated, F.lit(" +0000")), app_name=F.col("component"), bug_type=bug,
            incident_id=F.concat(F.lit("I"), F.col("entry_id")), os_version=F.lit("OS 1"),
        )
        body = [header, F.lit("{"), F.concat(F.lit('  "reason": "'), F.col("event_type"), F.lit('"')), F.lit("}")]
    else:
        hour_later = F.date_format(F.timestamp_micros(F.unix_micros("timestamp") + 3_600_000_000), "yyyy-MM-dd HH:mm:ss")
        body = [
            F.concat(F.lit("Date/Time:        "), dated, F.lit(" +0000")),
            F.lit("OS Version: 1"),
            F.concat(F.lit("Event: "), F.col("event_type")),
            F.concat(hour_later, F.lit(" +0000 "), F.when(F.col("level") >= 4, "Panic").otherwise("hang"), F.lit(" seen")),
        ]
    return log.select(
        F.format_string(f"{kind}-%d", F.col("entry_id")).alias("source_id"),
        F.posexplode(F.array(*body)).alias("_i", "raw_line"),
    ).select("source_id", (F.col("_i") + 1).cast("long").alias("line_number"), "raw_line")


MIXED = ["sccm", "json", "unified", "iso", "bracketed"]
MIXED_FORMATS = ["sccm", "json", "unified", "plain", "plain"]


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with one file per user, in five formats."""
    log = events_log(spark, sf)
    line = None
    for i, fmt in enumerate(MIXED):
        line = (line.when if line is not None else F.when)(F.col("user_id") % len(MIXED) == i, rendered(fmt))
    files = log.select(F.col("component").alias("source_id"), "entry_id", line.alias("raw_line"))
    return number_rows(files, "entry_id", "line_number", keys=["source_id"])


# ---------------------------------------------------------------- error codes from the rows


def code_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """``(entry_id, input, domain)``: texts to look up, made of each order's numbers.

    The priority says how they are written: customers as decimals, order keys as negative decimals,
    customers above a driver's base in hexadecimal, digests of the key, and the status as a symbol.
    """
    key, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    priority = F.substring("o_orderpriority", 1, 1)
    symbol = F.when(status == "F", "sqlite_full").when(status == "O", "EBUSY").otherwise("errSecIO")
    return table(spark, sf, "orders").select(
        key.alias("entry_id"),
        F.when(priority == "1", customer.cast("string"))
        .when(priority == "2", F.concat(F.lit("-"), key.cast("string")))
        .when(priority == "3", F.concat(F.lit("0x"), F.hex(customer + 0xE0000200)))
        .when(priority == "4", F.concat(F.lit("0x"), F.md5(key.cast("string"))))
        .otherwise(symbol)
        .alias("input"),
        F.when(priority == "1", "HTTP")
        .when(priority == "2", "CFNetwork")
        .when(priority == "3", "IOReturn")
        .when(priority == "4", "OSStatus")
        .when(status == "F", "SQLite")
        .when(status == "O", "errno")
        .otherwise("HTTP")
        .alias("domain"),
    )


CODE_INPUTS_SQL = """
asked AS (
  SELECT o_orderkey AS entry_id,
         CASE left(o_orderpriority, 1) WHEN '1' THEN CAST(o_custkey AS VARCHAR) WHEN '2' THEN '-' || o_orderkey
              WHEN '3' THEN '0x' || upper(to_hex(o_custkey + 3758096896)) WHEN '4' THEN '0x' || md5(CAST(o_orderkey AS VARCHAR))
              ELSE CASE o_orderstatus WHEN 'F' THEN 'sqlite_full' WHEN 'O' THEN 'EBUSY' ELSE 'errSecIO' END END AS t,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'HTTP' WHEN '2' THEN 'CFNetwork' WHEN '3' THEN 'IOReturn' WHEN '4' THEN 'OSStatus'
              ELSE CASE o_orderstatus WHEN 'F' THEN 'SQLite' WHEN 'O' THEN 'errno' ELSE 'HTTP' END END AS domain
  FROM orders
)"""


def code_messages(spark: SparkSession, sf: str) -> DataFrame:
    """``(entry_id, message)``: each event's numbers as the codes of a log message."""
    kind = F.col("event_type")
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    k = F.regexp_extract("props", r"\d+", 0)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("entry_id"),
        F.when(kind == "error", F.concat(F.lit("gave up on user "), user, F.lit(": error -"), k))
        .when(kind == "purchase", F.concat(F.lit("basket kept, errno="), user, F.lit(" after errno="), k))
        .when(kind == "view", F.concat(F.lit("page "), k, F.lit(" left with OSStatus -"), event))
        .when(kind == "click", F.concat(F.lit("trace 0x"), F.md5(event), F.lit(" ended in error "), k))
        .when(kind == "signup", F.concat(F.lit("driver said 0x"), F.hex(k.cast("long") + 0xE00002BC)))
        .otherwise(F.concat_ws(" ", kind, "props"))
        .alias("message"),
    )


CODE_MESSAGES_SQL = r"""
said AS (
  SELECT event_id AS entry_id,
         CASE event_type WHEN 'error' THEN 'gave up on user ' || user_id || ': error -' || k
              WHEN 'purchase' THEN 'basket kept, errno=' || user_id || ' after errno=' || k
              WHEN 'view' THEN 'page ' || k || ' left with OSStatus -' || event_id
              WHEN 'click' THEN 'trace 0x' || md5(CAST(event_id AS VARCHAR)) || ' ended in error ' || k
              WHEN 'signup' THEN 'driver said 0x' || upper(to_hex(CAST(k AS BIGINT) + 3758097084))
              ELSE event_type || ' ' || props END AS m
  FROM (SELECT *, regexp_extract(props, '\d+') AS k FROM events)
)"""


# ---------------------------------------------------------------- many files


def customer_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as one log file for each customer, whose lines are numbered from the start."""
    log = orders_log(spark, sf).drop("line_number").withColumn("source_id", F.col("component"))
    numbered = number_rows(log.withColumnRenamed("entry_id", "order_key"), "order_key", "line_number", keys=["source_id"])
    return numbered.withColumn("entry_id", F.col("line_number") - 1)


CUSTOMER_LOGS_SQL = (
    ORDERS_LOG_SQL
    + """,
files AS (
  SELECT * REPLACE (component AS source_id, row_number() OVER f - 1 AS entry_id, row_number() OVER f AS line_number)
  FROM orders_log WINDOW f AS (PARTITION BY component ORDER BY entry_id)
)"""
)
