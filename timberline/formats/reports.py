"""Crash reports (JSON header line, free body) and diagnostic reports (``Date/Time:`` header)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import LogFormat, ParseContext, Sample, fields, staged
from timberline.functions import levels as L
from timberline.functions.text import parse_json_object, trim_blanks
from timberline.functions.times import parse_timestamp
from timberline.schema import ERROR, INFO
from timberline.settle import once

DIAG_HEADER_LINES = 20


def _ips_header(head: Column, ctx: ParseContext) -> Column:
    first = F.get(F.filter(head, lambda r: r["line_number"] == 1), F.lit(0))["raw_line"]

    def read(obj: Column) -> Column:
        def member(name: str) -> Column:
            return F.element_at(obj, F.lit(name))

        return F.when(
            obj.isNotNull(),
            F.struct(
                parse_timestamp(member("timestamp"), "report", ctx.tz).alias("time"),
                member("app_name").alias("app"),
                member("bug_type").alias("bug"),
                member("incident_id").alias("incident"),
                member("os_version").alias("os"),
            ),
        )

    return once(trim_blanks(first), lambda text: once(parse_json_object(text), read))


def _ips_title(header: Column) -> Column:
    return F.concat_ws(
        " · ",
        F.concat(
            F.coalesce(header["app"], F.lit("?")),
            F.lit(" — bug_type "),
            F.coalesce(header["bug"], F.lit("?")),
        ),
        F.concat(F.lit("incident "), header["incident"]),
        header["os"],
    )


def _parse_ips(df: DataFrame, active: Column, ctx: ParseContext):
    header, title_row = F.col(IPS.header_column()), F.col("line_number") == 0
    bug = header["bug"]
    severity = F.when(bug.isNull(), F.lit(INFO)).otherwise(
        F.coalesce(L.word_level(bug, L.BUG_TYPES), F.lit(ERROR))
    )
    return df, fields(
        timestamp=header["time"],
        level=F.when(title_row, severity).otherwise(F.lit(INFO)),
        message=F.col("raw_line"),
        component=header["app"],
        source_ref=F.when(title_row, F.lit("header")),
    )


def _score_ips(sample: Sample) -> Column:
    first = trim_blanks(sample.first)
    hit = (
        first.startswith("{")
        & first.endswith("}")
        & first.contains('"timestamp"')
        & first.contains('"bug_type"')
    )
    return F.when(hit, F.lit(0.95)).otherwise(F.lit(0.0))


IPS = LogFormat("ips", _score_ips, _parse_ips, header=_ips_header, title=_ips_title, header_lines=1)


def _diag_header(head: Column, ctx: ParseContext) -> Column:
    mark = "Date/Time:"
    dated = F.filter(
        head, lambda r: (r["line_number"] <= DIAG_HEADER_LINES) & r["raw_line"].startswith(mark)
    )
    times = F.transform(
        dated,
        lambda r: parse_timestamp(
            trim_blanks(F.regexp_replace(r["raw_line"], "^Date/Time:", "")), "report", ctx.tz
        ),
    )
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def _parse_diag(df: DataFrame, active: Column, ctx: ParseContext):
    raw, default = F.col("raw_line"), F.col(DIAG.header_column())
    shape = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s*[+-]\d{4})?)"
    inline = F.regexp_replace(F.regexp_extract(raw, shape, 1), r"\s+", " ")
    df = staged(df, _diag_inline=F.when(active, inline))
    known = default.isNotNull()
    return df, fields(
        timestamp=F.when(known, F.coalesce(parse_timestamp(F.col("_diag_inline"), "report", ctx.tz), default)),
        level=F.when(known, L.report_level(raw)).otherwise(F.lit(INFO)),
        message=raw,
    )


def _score_diag(sample: Sample) -> Column:
    hit = F.exists(sample.head(3), lambda s: s.startswith("Date/Time:"))
    return F.when(hit, F.lit(0.9)).otherwise(F.lit(0.0))


DIAG = LogFormat("diag", _score_diag, _parse_diag, header=_diag_header, header_lines=DIAG_HEADER_LINES)
