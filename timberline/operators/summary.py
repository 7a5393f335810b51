"""Counts and flags over a whole log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.ordered import Run, number_sorted, running
from timberline.schema import LEVELS


def level_counts(df: DataFrame) -> DataFrame:
    """``(level, name, rows)`` for all seven levels, zero where absent."""
    counts = df.agg(*[F.count_if(F.col("level") == rank).alias(name) for rank, name, _, _ in LEVELS])
    rows = [
        F.struct(
            F.lit(rank).alias("level"), F.lit(display).alias("name"), F.col(name).alias("rows")
        )
        for rank, name, display, _ in LEVELS
    ]
    return counts.select(F.inline(F.array(*rows)))


def level_counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per level and key: partial counts first, so a hot key costs one row per task."""
    return df.groupBy(*keys, "level").agg(F.count("*").alias("rows"))


def column_flags(df: DataFrame) -> DataFrame:
    """One row: does any row have a timestamp, a component."""
    def present(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col(name).isNotNull()), F.lit(False))

    return df.agg(
        present("timestamp").alias("has_timestamps"), present("component").alias("has_components")
    )


def component_dictionary(
    df: DataFrame, order: str = "entry_id", cap: int | None = None, keys=("source_id",)
) -> DataFrame:
    """``(component_id, component, *keys, first_row, rows)``, ids from 1 by first appearance.

    Rows are in the order of ``keys`` and ``order``, file by file. 0 stands for no component. All are
    numbered; only with a ``cap``, such as 65 535 for a 16-bit column, components first seen after the
    cap get no id.
    """
    found = (
        df.where(F.col("component") != "")
        .groupBy("component")
        .agg(F.min(F.struct(*keys, F.col(order).alias("first_row"))).alias("_first"), F.count("*").alias("rows"))
        .select("component", "_first.*", "rows")
    )
    by_first = [F.col(k).asc_nulls_first() for k in keys] + [F.col("first_row"), F.col("component")]
    if cap is None:
        numbered = number_sorted(found, by_first, "component_id", 1, "components")
    else:
        numbered = found.orderBy(*by_first).limit(cap).withColumn(
            "component_id", F.row_number().over(Window.orderBy(*by_first)).cast("long")
        )
    return numbered.select("component_id", "component", *keys, "first_row", "rows")


def encode_components(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``component_id``, 0 for rows without one or with one beyond the cap."""
    ids = dictionary.select("component", "component_id")
    return df.join(ids, "component", "left").withColumn(
        "component_id", F.coalesce("component_id", F.lit(0).cast("long"))
    )


def time_inversions(df: DataFrame, order: str = "line_number") -> DataFrame:
    """Per source: is it out of time order, how many rows step back, the worst step in µs."""
    us = F.unix_micros("timestamp")
    df = running(
        df.select("source_id", order, "timestamp"),
        order,
        {"_before": Run("last", us, inclusive=False)},
        keys=["source_id"],
    )
    step = F.col("_before") - us
    return df.groupBy("source_id").agg(
        F.coalesce(F.bool_or(step > 0), F.lit(False)).alias("out_of_order"),
        F.count_if(step > 0).alias("inversions"),
        F.coalesce(F.max(F.when(step > 0, step)), F.lit(0).cast("long")).alias("worst_us"),
    )
