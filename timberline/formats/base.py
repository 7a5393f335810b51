"""What a log format is: a score over a file's first lines and a parse over its lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.schema import PARSED_FIELDS
from timberline.settle import settle, staged

__all__ = ["LogFormat", "ParseContext", "Sample", "fields", "settle", "staged", "struct_parse"]


#: Lines at the top of a file from which its format is told.
SAMPLE_LINES = 50


@dataclass(frozen=True)
class ParseContext:
    """Settings of one parse: zone of times without offset, the clock for years, options."""

    tz: str = "UTC"
    now: object = None
    honor_offset: bool = False


@dataclass(frozen=True)
class Sample:
    """First lines of a file, empties dropped, as columns."""

    lines: Column

    @property
    def first(self) -> Column:
        return F.get(self.lines, F.lit(0))

    @property
    def joined(self) -> Column:
        return F.array_join(self.lines, " ")

    def head(self, n: int) -> Column:
        return F.slice(self.lines, 1, n)


# df, rows this format owns, settings -> df with helper columns, and one column per parsed field
Parse = Callable[[DataFrame, Column, ParseContext], tuple[DataFrame, dict[str, Column]]]


@dataclass(frozen=True)
class LogFormat:
    """A parser.

    A file-scoped format also gives ``header``: what a file's first lines (array of
    ``line_number, raw_line``) say about all its lines. The parse finds it, once per line, in
    the column :meth:`header_column`. ``title`` may turn it into the text of one extra line 0.
    ``header_lines`` says how many of the first lines ``header`` looks at, by their numbers.
    """

    name: str
    score: Callable[[Sample], Column]
    parse: Parse
    header: Callable[[Column, ParseContext], Column] | None = None
    title: Callable[[Column], Column] | None = None
    header_lines: int = SAMPLE_LINES

    @property
    def file_scoped(self) -> bool:
        return self.header is not None

    def header_column(self) -> str:
        return f"_header_{self.name}"


def struct_parse(make: Callable[[Column, Column], Column]) -> Parse:
    """A parse from one expression ``(raw_line, line_number) -> struct of the parsed fields``.

    ``make`` may be plain column code or a pandas UDF returning that struct.
    """

    def parse(df: DataFrame, active: Column, ctx: ParseContext):
        name = f"_struct_{abs(hash(make))}"
        df = df.withColumn(name, F.when(active, make(F.col("raw_line"), F.col("line_number"))))
        return df, {field: F.col(name)[field] for field in PARSED_FIELDS}

    return parse


def fields(**given: Column) -> dict[str, Column]:
    """Parsed fields with the absent ones null."""
    return {name: given.get(name, F.lit(None)) for name in PARSED_FIELDS}
