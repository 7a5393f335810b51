"""Configuration-manager trace lines: ``<![LOG[message]LOG]!><time=… date=… …>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import LogFormat, ParseContext, Sample, fields, staged
from timberline.functions import levels as L
from timberline.functions.text import captured
from timberline.functions.times import parse_timestamp
from timberline.schema import INFO

# Fixed value: the line shape.
TRACE = (
    r'(?s)<!\[LOG\[(.*?)\]LOG\]!><time="([^"]*)" date="([^"]*)" component="([^"]*)" '
    r'context="[^"]*" type="(\d)" thread="(\d+)" file="([^"]*)">'
)


def _parse(df: DataFrame, active: Column, ctx: ParseContext):
    raw, parts = F.col("raw_line"), F.col("_sccm_parts")
    whole = TRACE.replace("(?s)", "(?s)^.*?") + ".*$"
    df = staged(df, _sccm_parts=F.when(active & raw.rlike(TRACE), captured(raw, whole, 7)))

    def group(n: int) -> Column:
        return F.get(parts, F.lit(n - 1))

    # The clock up to its offset, which is discarded unless asked for.
    clock = F.nullif(F.regexp_extract(group(2), r"^[\d:.]+", 0), F.lit(""))
    df = staged(df, _sccm_time=F.concat_ws(" ", group(3), F.coalesce(clock, group(2))))
    text = F.col("_sccm_time")
    time = parse_timestamp(text, "sccm", ctx.tz)
    if ctx.honor_offset:
        # The suffix is minutes to add to local time to reach UTC.
        minutes = F.regexp_extract(group(2), r"([+-]\d{1,4})$", 1).try_cast("int")
        utc = parse_timestamp(text, "sccm", "UTC")
        shifted = F.timestamp_micros(F.unix_micros(utc) + minutes.cast("long") * 60_000_000)
        time = F.when(minutes.isNotNull(), shifted).otherwise(time)
    hit = parts.isNotNull()
    return df, fields(
        timestamp=F.when(hit, time),
        level=F.when(hit, F.coalesce(L.word_level(group(5), L.SCCM_TYPES), F.lit(INFO))).otherwise(
            L.detect_level(raw)
        ),
        message=F.coalesce(group(1), raw),
        component=F.nullif(group(4), F.lit("")),
        thread_id=group(6),
        source_ref=F.nullif(group(7), F.lit("")),
    )


def _score(sample: Sample) -> Column:
    head = sample.head(10)
    traced = F.filter(head, lambda s: s.contains("<![LOG[") & s.contains("]LOG]!>"))
    return F.when(F.size(head) > 0, F.size(traced) / F.size(head) * 0.95).otherwise(F.lit(0.0))


SCCM = LogFormat("sccm", _score, _parse)
