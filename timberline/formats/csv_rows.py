"""CSV with a header row. Headers decide detection only; columns are told apart by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import LogFormat, ParseContext, Sample, fields, staged
from timberline.functions import levels as L
from timberline.functions.text import split_csv_row, trim_blanks
from timberline.functions.times import is_timestamp, parse_timestamp
from timberline.schema import DEBUG

# Header names that make a table a log.
TIMESTAMP_HEADERS = ["timestamp", "time", "datetime", "date", "ts", "@timestamp"]
LEVEL_HEADERS = ["level", "severity", "loglevel", "log_level", "priority"]
MESSAGE_HEADERS = ["message", "msg", "text", "body", "description", "log"]
# Words a component column may not be.
NOT_COMPONENTS = ["debug", "trace", "info", "notice", "warn", "warning", "error", "fatal", "critical"]


def _parse(df: DataFrame, active: Column, ctx: ParseContext):
    raw, cols = F.col("raw_line"), F.col("_csv_cols")
    # Live lines may come without a number.
    header = F.coalesce(F.col("line_number") == 1, F.lit(False))
    df = staged(df, _csv_cols=F.when(active & ~header, split_csv_row(raw)))

    df = staged(df, _csv_bare=F.transform(cols, trim_blanks))
    bare = F.col("_csv_bare")

    def column_level(value: Column) -> Column:
        return L.word_level(F.lower(value), L.CSV_LEVEL_WORDS)

    named = F.get(F.filter(F.transform(bare, column_level), lambda v: v.isNotNull()), F.lit(0))
    middle = F.slice(cols, F.lit(2), F.greatest(F.size(cols) - 2, F.lit(0)))
    short = F.filter(
        middle,
        lambda v: (F.length(v) > 0)
        & (F.length(v) < 50)
        & ~is_timestamp(trim_blanks(v), "csv", ctx.tz)
        & ~F.lower(trim_blanks(v)).isin(*NOT_COMPONENTS),
    )
    df = staged(df, _csv_longest=F.array_max(F.transform(cols, lambda v: F.length(v))))
    return df, fields(
        timestamp=F.coalesce(*[parse_timestamp(F.get(bare, F.lit(i)), "csv", ctx.tz) for i in range(3)]),
        level=F.when(active & header, F.lit(DEBUG))
        .when(active, F.coalesce(named, L.detect_level(F.array_join(cols, " ")))),
        message=F.when(header, F.concat(F.lit("CSV Header: "), raw)).otherwise(
            F.get(F.filter(cols, lambda v: F.length(v) == F.col("_csv_longest")), F.lit(0))
        ),
        component=F.when(F.size(cols) > 3, F.get(short, F.lit(0))),
    )


def _score(sample: Sample) -> Column:
    columns = split_csv_row(sample.first)
    names = F.transform(columns, lambda c: trim_blanks(F.lower(c)))
    second = split_csv_row(F.get(sample.lines, F.lit(1)))

    def has(words: list[str]) -> Column:
        return F.arrays_overlap(names, F.array(*[F.lit(w) for w in words]))

    table = (F.size(sample.lines) >= 2) & (F.size(columns) >= 2) & (F.size(second) == F.size(columns))
    return (
        F.when(table & has(MESSAGE_HEADERS) & (has(LEVEL_HEADERS) | has(TIMESTAMP_HEADERS)), F.lit(0.8))
        .when(table & has(MESSAGE_HEADERS), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


CSV = LogFormat("csv", _score, _parse)
