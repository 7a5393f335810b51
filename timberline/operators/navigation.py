"""Stepping through logs: matches, visible positions, neighbouring errors, rows near a time.

Lines are numbered from the start in every file, so all of these work within ``keys``, by default each
source by itself. ``keys=[]`` is for rows that are numbered through, such as a merged log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordered import Run, running
from timberline.schema import ERROR

PER_FILE = ("source_id",)


def match_list(
    df: DataFrame, hit: Column, order: str = "entry_id", label: str = "line_number", keys=PER_FILE
) -> DataFrame:
    """Matching rows with their position, the number of matches, and the ``label`` of the next
    and previous match of the file, wrapping around at its ends.
    """
    at = F.struct(F.col(order).alias("o"), F.col(label).alias("l"))
    out = running(
        df.where(hit),
        order,
        {
            "_n": Run("sum", F.lit(1).cast("long")),
            "_next": Run("first", F.struct(F.col(label).alias("l")), inclusive=False),
            "_prev": Run("last", F.struct(F.col(label).alias("l")), inclusive=False),
        },
        list(keys),
        totals={"_first": F.min(at)["l"], "_last": F.max(at)["l"], "match_count": F.count("*")},
    )
    return out.withColumns(
        {
            "match_index": F.col("_n") - 1,
            "next_match": F.coalesce(F.col("_next.l"), F.col("_first")),
            "previous_match": F.coalesce(F.col("_prev.l"), F.col("_last")),
        }
    ).drop("_n", "_next", "_prev", "_first", "_last")


def visible_position(
    df: DataFrame, visible: Column, order: str = "entry_id", name: str = "position", keys=PER_FILE
) -> DataFrame:
    """Add the row's index from 0 among the file's visible rows; null where hidden."""
    shown = F.coalesce(visible, F.lit(False))
    out = running(df, order, {"_n": Run("sum", F.when(shown, 1).otherwise(0).cast("long"))}, list(keys))
    return out.withColumn(name, F.when(shown, F.col("_n") - 1)).drop("_n")


def neighbouring_errors(
    df: DataFrame, order: str = "entry_id", label: str = "line_number", min_level: int = ERROR, keys=PER_FILE
) -> DataFrame:
    """Add ``next_error`` and ``previous_error``: labels of the nearest later and earlier rows of
    the file of at least ``min_level``; null at the ends.
    """
    value = F.when(F.col("level") >= min_level, F.struct(F.col(label).alias("l")))
    out = running(
        df,
        order,
        {
            "_next": Run("first", value, inclusive=False),
            "_prev": Run("last", value, inclusive=False),
        },
        list(keys),
    )
    return out.withColumns({"next_error": F.col("_next.l"), "previous_error": F.col("_prev.l")}).drop(
        "_next", "_prev"
    )


def nearest_rows(df: DataFrame, targets: list[int], order: str = "entry_id", keys=PER_FILE) -> DataFrame:
    """``(*keys, target_us, row)`` for a few times, in each file: the last row at or before each, the
    later of equal ones; before all rows, the first timed row; null in a file without times. One pass.

    For times in a table use :func:`timberline.operators.asof.asof_join`.
    """
    us = F.unix_micros("timestamp")
    at = F.struct(us.alias("t"), F.col(order).alias("r"))
    found = df.groupBy(*keys).agg(
        F.min(F.when(us.isNotNull(), F.col(order))).alias("_first"),
        *[F.max(F.when(us <= t, at))["r"].alias(f"_{i}") for i, t in enumerate(targets)],
    )
    rows = [
        F.struct(
            F.lit(t).cast("long").alias("target_us"),
            F.coalesce(F.col(f"_{i}"), F.col("_first")).alias("row"),
        )
        for i, t in enumerate(targets)
    ]
    return found.select(*keys, F.inline(F.array(*rows)))
