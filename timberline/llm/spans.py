"""Matches with their places, as column expressions. Places are code points, the end exclusive."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string>"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>>: all matches from the left, none overlapping.

    What lies between the matches is as long as the places say, so one split and one extraction
    give them; nothing is computed for a text without a match.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        more = F.struct(F.concat(acc["spans"], F.array(span)).alias("spans"), end.alias("at"))
        return F.when(x["match"].isNull(), acc).otherwise(more)

    begin = F.struct(none_of(SPAN).alias("spans"), F.lit(0).alias("at"))
    return F.when(text.rlike(pattern), F.aggregate(both, begin, step, lambda acc: acc["spans"])).otherwise(none_of(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    flipped = F.reverse(number)
    each = F.transform(F.split(flipped, ""), lambda d, i: _luhn_digit(F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    double = 2 * d
    return F.when(i % 2 == 0, d).otherwise(F.when(double > 9, double - 9).otherwise(double))


KINDED = "struct<start:int,rank:int,end:int,kind:string>"


def kinded(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def together(parts: Sequence[Column]) -> Column:
    """By start, then in the kinds' order."""
    return F.array_sort(F.concat(none_of(KINDED), *parts))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps_any(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = F.struct(F.concat(acc["out"], gap, name).alias("out"), s["end"].alias("at"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, end)).otherwise(text)


def total(values: Column) -> Column:
    return functools.reduce(lambda a, b: a + b, values)
