"""Highlight rules and bookmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.filters import valid_pattern
from timberline.operators.ordered import number_rows


@dataclass(frozen=True)
class HighlightRule:
    name: str
    pattern: str
    color: int
    enabled: bool = True


def highlight(df: DataFrame, rules: list[HighlightRule], name: str = "highlight") -> DataFrame:
    """Add the colour and name of the first rule, in list order, found in the message."""
    usable = [r for r in rules if r.enabled and r.pattern and valid_pattern(r.pattern)]
    chosen = None
    for i, rule in enumerate(usable):
        chosen = (chosen.when if chosen is not None else F.when)(F.col("message").rlike(rule.pattern), F.lit(i))
    if chosen is None:
        chosen = F.lit(None).cast("int")
    df = df.withColumn("_rule", chosen)
    values: dict[str, str] = {f"{name}_rule": "name", f"{name}_color": "color"}
    for column, attribute in values.items():
        kind = "string" if attribute == "name" else "int"
        options = F.array(*[F.lit(getattr(r, attribute)).cast(kind) for r in usable]).cast(f"array<{kind}>")
        df = df.withColumn(column, F.get(options, F.col("_rule")))
    return df.drop("_rule")


_KEY = ["source_id", "line_number"]


def toggle_bookmarks(bookmarks: DataFrame, toggles: DataFrame) -> DataFrame:
    """Bookmarks after toggling each ``(source_id, line_number)`` once: the symmetric difference."""
    both = bookmarks.select(*_KEY).distinct().unionByName(toggles.select(*_KEY).distinct())
    return both.groupBy(*_KEY).agg(F.count("*").alias("_n")).where(F.col("_n") == 1).select(*_KEY)


def bookmarked(df: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Rows that carry a bookmark."""
    return df.join(bookmarks.select(*_KEY).distinct(), _KEY, "left_semi")


def bookmarks_by_source(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks as an ordered list per source: position in it, and the source's total."""
    marks = bookmarks.select(*_KEY).distinct()
    totals = marks.groupBy("source_id").agg(F.count("*").alias("total"))
    listed = number_rows(marks, "line_number", "position", keys=["source_id"])
    return listed.join(totals, "source_id")
