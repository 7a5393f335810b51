"""Filters compiled to one predicate, presets, find mode."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import lru_cache, reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.schema import LEVELS, level_rank

ALL_LEVELS = frozenset(rank for rank, *_ in LEVELS)


@lru_cache(maxsize=1024)
def valid_pattern(pattern: str) -> bool:
    """Whether Spark accepts the regular expression."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
        return True
    except PySparkException:
        return False


def text_predicate(
    column: Column, text: str, regex: bool = False, case_sensitive: bool = False
) -> Column:
    """Literal or regular-expression search; an invalid pattern matches nothing."""
    if not text:
        return F.lit(True)
    if regex:
        if not valid_pattern(text):
            return F.lit(False)
        found = column.rlike(text if case_sensitive else f"(?i){text}")
    elif case_sensitive:
        found = column.contains(text)
    else:
        found = F.lower(column).contains(F.lower(F.lit(text)))
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class LogFilter:
    """What to show. ``min_level=None`` sets no minimum, so that unknown levels pass."""

    text: str = ""
    regex: bool = False
    case_sensitive: bool = False
    on: str = "message"
    min_level: int | None = None
    levels: frozenset[int] = ALL_LEVELS
    component: str | None = None
    hidden_sources: frozenset[str] = field(default_factory=frozenset)
    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self):
        column = {"message": "message", "raw": "raw_line"}
        if self.on not in column:
            raise ValueError("on must be 'message' or 'raw'")
        object.__setattr__(self, "levels", frozenset(level_rank(v) for v in self.levels))
        object.__setattr__(self, "hidden_sources", frozenset(self.hidden_sources))
        if self.min_level is not None:
            object.__setattr__(self, "min_level", level_rank(self.min_level))

    @property
    def is_active(self) -> bool:
        return self != LogFilter(on=self.on, regex=self.regex, case_sensitive=self.case_sensitive)

    def row_predicate(self) -> Column:
        """Everything but the text: level, component, source, time; cheapest first."""
        tests = []
        if self.levels != ALL_LEVELS:
            tests.append(F.col("level").isin(*sorted(self.levels)))
        if self.min_level is not None:
            tests.append(F.col("level") >= self.min_level)
        if self.component is not None:
            tests.append(F.col("component") == self.component)
        if self.hidden_sources:
            source = F.col("source_id")
            tests.append(source.isNull() | ~source.isin(*sorted(self.hidden_sources)))
        if self.start is not None:
            tests.append(F.col("timestamp") >= F.lit(self.start))
        if self.end is not None:
            tests.append(F.col("timestamp") <= F.lit(self.end))
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def search_predicate(self) -> Column:
        column = F.col("message" if self.on == "message" else "raw_line")
        return text_predicate(column, self.text, self.regex, self.case_sensitive)

    def predicate(self) -> Column:
        return self.row_predicate() & self.search_predicate() if self.text else self.row_predicate()


def apply_filter(df: DataFrame, flt: LogFilter) -> DataFrame:
    """Rows that pass; batch or streaming."""
    return df.where(flt.predicate()) if flt.is_active else df


def find(df: DataFrame, flt: LogFilter, name: str = "is_match") -> DataFrame:
    """Find mode: the text marks rows, everything else hides them."""
    hit = flt.search_predicate() if flt.text else F.lit(False)
    return df.where(flt.row_predicate()).withColumn(name, hit)


def visible_of_total(df: DataFrame, flt: LogFilter) -> DataFrame:
    """One row ``(visible, total)``."""
    shown = F.coalesce(flt.predicate(), F.lit(False))
    return df.agg(F.count_if(shown).alias("visible"), F.count("*").alias("total"))


@dataclass(frozen=True)
class FilterPreset:
    """A saved filter. Minimum level, hidden sources and time range are not part of it."""

    name: str
    text: str = ""
    regex: bool = False
    case_sensitive: bool = False
    levels: frozenset[int] = ALL_LEVELS
    component: str | None = None

    _SAVED = ("text", "regex", "case_sensitive", "levels", "component")

    @classmethod
    def save(cls, name: str, flt: LogFilter) -> FilterPreset:
        return cls(name, **{n: getattr(flt, n) for n in cls._SAVED})

    def apply(self, flt: LogFilter) -> LogFilter:
        return replace(flt, **{n: getattr(self, n) for n in self._SAVED})

    def matches(self, flt: LogFilter) -> bool:
        return all(getattr(self, n) == getattr(flt, n) for n in self._SAVED)

    def to_json(self) -> str:
        saved = {n: getattr(self, n) for n in self._SAVED} | {"levels": sorted(self.levels)}
        return json.dumps({"name": self.name} | saved, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FilterPreset:
        saved = json.loads(text)
        return cls(**(saved | {"levels": frozenset(saved["levels"])}))


def toggle_level(flt: LogFilter, level: int | str) -> LogFilter:
    """Only this level, or all again if it was the only one."""
    only = frozenset({level_rank(level)})
    return replace(flt, levels=ALL_LEVELS if flt.levels == only else only)


def preset_counts(df: DataFrame, presets: list[FilterPreset]) -> DataFrame:
    """``(preset, rows)`` of every preset in one pass over the rows."""
    blank = LogFilter()
    counts = df.agg(
        *[
            F.count_if(F.coalesce(p.apply(blank).predicate(), F.lit(False))).alias(f"_{i}")
            for i, p in enumerate(presets)
        ]
    )
    pairs = [F.struct(F.lit(p.name).alias("preset"), F.col(f"_{i}").alias("rows")) for i, p in enumerate(presets)]
    return counts.select(F.inline(F.array(*pairs)))
