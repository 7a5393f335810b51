"""Paths, CSV rows and JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks trimmed off a line: tab and the Unicode space separators.
BLANKS = " \t               　"

_FIELD_BREAK = "\u001f\u001e\u001f"


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trim_blank_lines(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS + "\n\r\u000b\u000c\u0085  "))


def basename(path: Column) -> Column:
    """Last path component."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def csv_field(text: Column) -> Column:
    """Always quoted, embedded quotes doubled; null is the empty field."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def split_csv_row(text: Column) -> Column:
    """Fields of a CSV row: a quote toggles quoting and is dropped; commas inside stay.

    Linear in the row: text between quotes alternates outside/inside, so field breaks are the
    commas of every other piece.
    """
    pieces = F.transform(
        F.split(text, '"'),
        lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(","), F.lit(_FIELD_BREAK))).otherwise(piece),
    )
    return F.split(F.array_join(pieces, ""), _FIELD_BREAK)


_NUL = "\u0000"


def captured(text: Column, pattern: str, groups: int) -> Column:
    """Array of the capture groups of a pattern that is known to match all of ``text``.

    One run of the pattern instead of one per group: the groups are written out with a separator
    and split again. A text that itself has the separator takes the slow way.
    """
    joined = F.regexp_replace(text, pattern, _NUL.join(f"${i}" for i in range(1, groups + 1)))
    each = F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, groups + 1)])
    return F.when(text.contains(_NUL), each).otherwise(F.split(joined, _NUL))


def parse_json_object(text: Column) -> Column:
    """Map of a JSON object's members as text; null when ``text`` is not one object."""
    return F.when(
        text.startswith("{") & text.endswith("}"), F.from_json(text, "map<string,string>")
    )


def has_cased_keys(obj: Column) -> Column:
    """Whether any key of a JSON object has capitals."""
    return F.exists(F.map_keys(obj), lambda k: k != F.lower(k))


def json_get_ci(obj: Column, keys: list[str], cased: Column | None = None) -> Column:
    """Value of the first key present, each tried exactly and then in any case.

    Null members count as absent. ``cased`` is :func:`has_cased_keys`, as a column when several
    lookups share it: objects without capitals, the most, need plain lookups only.
    """
    cased = has_cased_keys(obj) if cased is None else cased
    forms = [form for k in keys for form in dict.fromkeys([k, k.lower()])]
    plain = F.coalesce(*[F.element_at(obj, F.lit(form)) for form in forms])
    exact = F.array(*[F.lit(k) for k in keys])
    low = F.array(*[F.lit(k.lower()) for k in keys])
    wanted = F.filter(
        F.map_entries(obj),
        lambda e: F.lower(e["key"]).isin(*sorted({k.lower() for k in keys})) & e["value"].isNotNull(),
    )
    ranked = F.transform(
        wanted,
        lambda e: F.struct(
            F.array_position(low, F.lower(e["key"])).alias("at"),
            F.when(F.array_contains(exact, e["key"]), 0).otherwise(1).alias("inexact"),
            e["value"].alias("value"),
        ),
    )
    return F.when(cased, F.array_min(ranked)["value"]).otherwise(plain)
