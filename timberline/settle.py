"""Columns computed once, where they are defined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(column: Column) -> Column:
    """Keep a later filter above this projection.

    Spark copies the expressions behind a column into any filter on it and would run the whole
    parse twice, once to filter and once to project. An expression tied to the partition number
    is not copied; the condition itself always holds.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add helper columns, settled: computed once, here, however often later steps use them.

    Settling also keeps Spark from deriving constraints of each helper in terms of the ones
    before it, which takes exponential time and memory when planning a filter or join on top.
    """
    return df.withColumns({name: settle(column) for name, column in columns.items()})


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
