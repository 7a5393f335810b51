"""Plain text: ten line shapes, tried in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import LogFormat, ParseContext, Sample, fields, staged
from timberline.functions import levels as L
from timberline.functions.text import captured, trim_blanks
from timberline.functions.times import parse_timestamp, yearless_timestamp
from timberline.schema import INFO

# The line shapes.
_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
BSD_SYSLOG = r"(?s)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[\d+\])?(?:\s*<(\w+)>)?:\s*(.*)"
APPLE_DAEMON = r"(?s)^(\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+\[([^\]]+)\]/\d+\s+(.*)$"
DATED_SYSLOG = (
    r"(?s)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}(?::?\d{2})?)?)"
    r"\s+([A-Za-z0-9][A-Za-z0-9._-]*)\s+([^\[]+?)(?:\[\d+\])?(?:\s*<\w+>)?:\s*(.*)"
)
BRACKETED = rf"(?s)^\[({_STAMP})(?:\s+([^\]]+))?\]\s*(?:\[([^\]]+)\]\s*)?(.*)"
PREFIX_TAGGED = rf"(?s)^\[([^\]]+)\]\s+({_STAMP})\s+(.*)"
LOGFMT = r'(?s)^time="([^"]+)"\s+level=(\w+)\s+msg=(?:"((?:[^"\\]|\\.)*)"|(\S.*))$'
DATED_COMPONENT = rf"(?s)^({_STAMP})\s+([^\[\s:]+)(?:\[\d+\])?:\s*(.*)"
ISO = rf"(?s)^({_STAMP})\s+(.*)"

SHAPES = {
    1: "bsd_syslog",
    2: "apple_daemon",
    3: "dated_syslog",
    4: "bracketed",
    5: "prefix_tagged",
    6: "logfmt",
    7: "dated_component",
    8: "iso",
    9: "level_prefix",
    10: "bare_text",
}


def _first_of(text: Column, tries: dict[int, str]) -> Column:
    out = F.lit(10)
    for shape, pattern in reversed(tries.items()):
        out = F.when(text.rlike(pattern), F.lit(shape)).otherwise(out)
    return out


def line_shape(text: Column) -> Column:
    """Number of the first shape that matches.

    How a line starts rules most shapes out, so each line meets two or three patterns, not ten.
    """
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(text.startswith("["), _first_of(text, {4: BRACKETED, 5: PREFIX_TAGGED, 9: L.LEVEL_PREFIX}))
        .when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}"),
            _first_of(text, {3: DATED_SYSLOG, 7: DATED_COMPONENT, 8: ISO}),
        )
        .when(text.startswith('time="'), _first_of(text, {6: LOGFMT}))
        .otherwise(_first_of(text, {1: BSD_SYSLOG, 2: APPLE_DAEMON, 9: L.LEVEL_PREFIX}))
    )


# Per shape: its pattern, how many groups it has, and which of them hold the time, the name, the
# level tag and the rest of the line.
_GROUPS = {
    1: (BSD_SYSLOG, 5, {"time": 1, "name": 3, "tag": 4, "body": 5}),
    2: (APPLE_DAEMON, 3, {"time": 1, "name": 2, "body": 3}),
    3: (DATED_SYSLOG, 4, {"time": 1, "name": 3, "body": 4}),
    4: (BRACKETED, 4, {"time": 1, "inner": 2, "tag": 3, "body": 4}),
    5: (PREFIX_TAGGED, 3, {"time": 2, "name": 1, "body": 3}),
    6: (LOGFMT, 4, {"time": 1, "tag": 2, "quoted": 3, "body": 4}),
    7: (DATED_COMPONENT, 3, {"time": 1, "name": 2, "body": 3}),
    8: (ISO, 2, {"time": 1, "body": 2}),
}


def _part(role: str) -> Column:
    out = None
    for shape, (_, _, roles) in _GROUPS.items():
        if role in roles:
            value = F.get(F.col("_plain_line.parts"), F.lit(roles[role] - 1))
            out = (out.when if out is not None else F.when)(F.col("_plain_line.shape") == shape, value)
    return out


def _parse(df: DataFrame, active: Column, ctx: ParseContext):
    text, shape = F.col("_plain_text"), F.col("_plain_shape")
    # Each step is a projection of its own, so that no pattern runs twice for one line.
    df = staged(df, _plain_text=F.when(active, trim_blanks(F.col("raw_line"))))
    df = staged(df, _plain_shape=line_shape(text))
    parts = None
    for number, (pattern, groups, _) in _GROUPS.items():
        found = captured(text, pattern, groups)
        parts = (parts.when if parts is not None else F.when)(shape == number, found)
    # Passing through a generator, of one row per line, cuts the expressions above off from the
    # patterns below. The planner traces join keys down to the scan by substitution, which over
    # this many steps would not end.
    line = F.struct(shape.alias("shape"), parts.alias("parts"))
    df = df.select("*", F.explode(F.array(line)).alias("_plain_line"))
    shape = F.col("_plain_line.shape")

    unescaped = F.replace(_part("quoted"), F.lit(r"\""), F.lit('"'))
    inner = _part("inner")
    time = F.regexp_replace(_part("time"), r"\s+", " ")
    df = staged(
        df,
        _plain_time=F.when(shape == 3, time).otherwise(_part("time")),
        _plain_words=F.when(shape <= 2, F.split(_part("time"), r"\s+")),
        _plain_tag=F.when(inner != "", trim_blanks(inner)).otherwise(trim_blanks(_part("tag"))),
        _plain_body=F.when(shape >= 9, text)
        .when((shape == 6) & text.rlike(r'\smsg="'), unescaped)
        .otherwise(_part("body")),
    )
    body, tag = F.col("_plain_body"), F.col("_plain_tag")
    df = staged(df, _plain_marked=F.when(shape == 4, L.interpret_bracket_tag(tag)))
    marked = F.col("_plain_marked")
    df = staged(
        df, _plain_level=F.when(shape.isin(1, 6), L.recognized_level(tag)).when(shape == 4, marked["level"])
    )
    named = F.col("_plain_level")
    may_lead = shape.isin(3, 5, 7, 8, 9) | ((shape == 1) & named.isNull())
    df = staged(df, _plain_prefix=F.when(may_lead, L.level_prefix(body)))
    prefix = F.col("_plain_prefix")

    level = (
        F.when(shape.isNull(), F.lit(None).cast("int"))
        .when(named.isNotNull(), named)
        .when(shape == 6, F.lit(INFO))
        .when(prefix.isNotNull(), L.recognized_level(F.get(prefix, F.lit(0))))
        .otherwise(L.detect_level(body))
    )
    component = (
        F.when(shape == 3, trim_blanks(_part("name")))
        .when(shape == 4, marked["component"])
        .when(shape >= 8, F.nullif(F.get(prefix, F.lit(1)), F.lit("")))
        .otherwise(_part("name"))
    )
    # Years are inferred only on the two shapes without one.
    moment = F.when(shape <= 2, yearless_timestamp(F.col("_plain_words"), ctx.now, ctx.tz)).otherwise(
        parse_timestamp(F.col("_plain_time"), "plain", ctx.tz)
    )
    message = F.coalesce(F.get(prefix, F.lit(2)), body)
    return df, fields(timestamp=moment, level=level, message=message, component=component)


def _score(sample: Sample) -> Column:
    return F.lit(0.1)


PLAIN = LogFormat("plain", _score, _parse)
