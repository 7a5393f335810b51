"""One JSON object per line, and the system log's JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import LogFormat, ParseContext, Sample, fields, staged
from timberline.functions import levels as L
from timberline.functions.text import (
    basename,
    has_cased_keys,
    json_get_ci,
    parse_json_object,
    trim_blank_lines,
)
from timberline.functions.times import epoch_number, parse_timestamp
from timberline.schema import INFO

# Member names looked for, in order.
MESSAGE_KEYS = ["message", "msg", "text", "body"]
COMPONENT_KEYS = ["logger", "component", "source", "module", "service", "name"]
THREAD_KEYS = ["thread", "threadId", "thread_id", "tid"]
TIME_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime", "date"]
LEVEL_KEYS = ["level", "severity", "loglevel", "log_level", "lvl"]
SCORED_LEVEL_KEYS = ["level", "severity", "loglevel"]
ARRAY_KEYS = ["timestamp", "level", "message", "severity", "eventMessage", "messageType"]


def _parse(df: DataFrame, active: Column, ctx: ParseContext):
    raw, obj = F.col("raw_line"), F.col("_json_obj")
    df = staged(df, _json_text=F.when(active, trim_blank_lines(raw)))
    df = staged(df, _json_obj=parse_json_object(F.col("_json_text")))
    df = staged(df, _json_cased=has_cased_keys(obj))

    def get(keys: list[str]) -> Column:
        return json_get_ci(obj, keys, F.col("_json_cased"))

    df = staged(df, _json_time=get(TIME_KEYS), _json_level=get(LEVEL_KEYS))
    time, level = F.col("_json_time"), F.col("_json_level")
    said = F.coalesce(get(["message", "msg"]), F.lit(""))
    return df, fields(
        timestamp=F.coalesce(parse_timestamp(time, "json", ctx.tz), epoch_number(time)),
        level=F.when(obj.isNull(), L.detect_level(raw))
        .when(level.isNull(), L.detect_level(said))
        .otherwise(F.coalesce(L.word_level(F.lower(level), L.JSON_LEVEL_WORDS), F.lit(INFO))),
        message=F.coalesce(get(MESSAGE_KEYS), raw),
        component=get(COMPONENT_KEYS),
        thread_id=get(THREAD_KEYS),
    )


def _score(sample: Sample) -> Column:
    head = sample.head(10)
    objects = F.filter(
        F.transform(head, lambda s: parse_json_object(trim_blank_lines(s))), lambda m: m.isNotNull()
    )
    leveled = F.exists(
        objects,
        lambda m: F.exists(F.map_keys(m), lambda k: F.lower(k).isin(*SCORED_LEVEL_KEYS)),
    )
    mostly = F.size(objects) / F.greatest(F.size(head), F.lit(1)) > 0.7
    keys = "|".join(f'"{k}"' for k in ARRAY_KEYS)
    array = F.btrim(sample.joined).startswith("[") & sample.joined.rlike(keys)
    return (
        F.when(mostly & leveled, F.lit(0.85))
        .when(mostly, F.lit(0.6))
        .when(array, F.lit(0.75))
        .otherwise(F.lit(0.0))
    )


JSON = LogFormat("json", _score, _parse)


def _parse_unified(df: DataFrame, active: Column, ctx: ParseContext):
    raw, obj = F.col("raw_line"), F.col("_unified_obj")
    text = F.btrim(trim_blank_lines(raw), F.lit("[],"))
    df = staged(df, _unified_text=F.when(active, text))
    df = staged(df, _unified_obj=parse_json_object(F.col("_unified_text")))

    def member(name: str) -> Column:
        return F.element_at(obj, F.lit(name))

    subsystem, category = member("subsystem"), member("category")
    component = F.when(
        F.coalesce(subsystem, F.lit("")) != "",
        F.concat_ws(":", subsystem, F.nullif(category, F.lit(""))),
    ).otherwise(basename(member("processImagePath")))
    thread = member("threadID")
    return df, fields(
        timestamp=parse_timestamp(member("timestamp"), "unified", ctx.tz),
        level=F.when(active, F.coalesce(
            L.word_level(F.lower(member("messageType")), L.UNIFIED_TYPES), F.lit(INFO)
        )),
        message=F.when(obj.isNull(), raw).otherwise(F.coalesce(member("eventMessage"), F.lit(""))),
        component=component,
        thread_id=F.when(thread.rlike(r"^-?\d+$"), thread),
    )


def _score_unified(sample: Sample) -> Column:
    text = sample.joined
    return (
        F.when(text.contains("messageType") & text.contains("eventMessage"), F.lit(0.9))
        .when(text.contains("processImagePath") & text.contains("subsystem"), F.lit(0.85))
        .otherwise(F.lit(0.0))
    )


UNIFIED = LogFormat("unified", _score_unified, _parse_unified)
