"""Running values and numbering over a global order, without a global sort in one task.

A window without partitions would pull every row into one task, and one partitioned by source
or time bucket would follow their skew. Two ways around it:

* :func:`running`, for an order given by a unique long (a line number, distinct microseconds):
  rows are windowed inside blocks of that long. A block of width ``w`` holds at most ``w`` rows
  however the data is skewed. Block totals, one row per block, are carried across blocks in two
  further small windows, and joined back on the block.
* :func:`number_sorted`, for any sort order: rows are range-sorted once on the full order (ties
  included, so that a hot timestamp is split), staged, and numbered by partition offset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import stage

BLOCK = 1_000_000
# Blocks per group of the second level.
SPAN = 65_536


@dataclass(frozen=True)
class Run:
    """One running value: ``sum`` or ``last`` from before, or ``first`` from after, of ``value``."""

    how: str
    value: Column
    inclusive: bool = True


def block_start(order: Column, width: int) -> Column:
    return order - F.pmod(order, F.lit(width).cast("long"))


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Add the keys as one struct column, in which null meets null under plain equality.

    Plain equality lets a join use the partitioning a window or aggregate left behind; a
    null-safe one would shuffle the rows again.
    """
    return (df.withColumn("_keys", F.struct(*keys)), ["_keys"]) if keys else (df, [])


_UP = Window.unboundedPreceding


def _over(run: Run, value: Column, keys: list[str], order: str, inclusive: bool) -> Column:
    """The running value inside one window partition.

    Frames only ever grow from the partition's start, which Spark keeps up row by row; one that
    reaches to the end is evaluated afresh for each row. What follows is therefore what precedes
    in the opposite order, at the price of a second sort of the same partitions.
    """
    way = F.desc(order) if run.how == "first" else F.asc(order)
    frame = Window.partitionBy(*keys).orderBy(way).rowsBetween(_UP, 0 if inclusive else -1)
    if run.how == "sum":
        return F.sum(value).over(frame)
    if run.how in ("first", "last"):
        return F.last(value, ignorenulls=True).over(frame)
    raise ValueError(run.how)


def _total(run: Run, value: Column, order: Column) -> Column:
    if run.how == "sum":
        return F.sum(value)
    edge = F.min if run.how == "first" else F.max
    return edge(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]


def _combine(run: Run, near: Column, far: Column) -> Column:
    if run.how == "sum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    return F.coalesce(near, far)


def running(
    df: DataFrame,
    order: str,
    runs: dict[str, Run],
    keys: list[str] | None = None,
    width: int = BLOCK,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values over ``order``, a long unique within ``keys`` (default: all rows).

    ``totals`` are aggregates over all rows of a key. The rows are shuffled once, by block; what
    each row learns from elsewhere comes with its block.
    """
    df, keys = keyed(df, keys or [])
    df = df.withColumns(
        {"_block": block_start(F.col(order), width)}
        | {f"_v_{n}": r.value for n, r in runs.items()}
    )
    local = [*keys, "_block"]
    rows = df.withColumns(
        {f"_n_{n}": _over(r, F.col(f"_v_{n}"), local, order, r.inclusive) for n, r in runs.items()}
    )

    blocks = df.groupBy(*keys, "_block").agg(
        *[_total(r, F.col(f"_v_{n}"), F.col(order)).alias(f"_t_{n}") for n, r in runs.items()]
    )
    carried = _carry(blocks, runs, keys, width)
    if totals:
        whole = df.groupBy(*keys).agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("_whole"))
        # Without keys this is one row.
        carried = carried.join(whole, keys) if keys else carried.withColumn("_whole", whole.scalar())
        carried = carried.select(*keys, "_block", *[c for c in carried.columns if c.startswith("_f_")], "_whole.*")
    rows = rows.join(carried, [*keys, "_block"], "left")
    out = rows.withColumns({n: _combine(r, F.col(f"_n_{n}"), F.col(f"_f_{n}")) for n, r in runs.items()})
    helpers = [c for n in runs for c in (f"_v_{n}", f"_n_{n}", f"_f_{n}")]
    return out.drop("_keys", "_block", *helpers)


def _carry(blocks: DataFrame, runs: dict[str, Run], keys: list[str], width: int) -> DataFrame:
    """Per block, the value carried in from the blocks before (or after) it."""
    blocks = blocks.withColumn("_group", block_start(F.col("_block"), width * SPAN))
    inside = [*keys, "_group"]
    near = blocks.withColumns(
        {f"_n_{n}": _over(r, F.col(f"_t_{n}"), inside, "_block", False) for n, r in runs.items()}
    )
    groups = blocks.groupBy(*keys, "_group").agg(
        *[_total(r, F.col(f"_t_{n}"), F.col("_block")).alias(f"_t_{n}") for n, r in runs.items()]
    )
    far = groups.select(
        *keys,
        "_group",
        *[_over(r, F.col(f"_t_{n}"), keys, "_group", False).alias(f"_g_{n}") for n, r in runs.items()],
    )
    return near.join(far, [*keys, "_group"], "left").select(
        *keys, "_block", *[_combine(r, F.col(f"_n_{n}"), F.col(f"_g_{n}")).alias(f"_f_{n}") for n, r in runs.items()]
    )


def number_rows(
    df: DataFrame,
    order: str,
    name: str = "row_number",
    keys: list[str] | None = None,
    start: int = 1,
    width: int = BLOCK,
) -> DataFrame:
    """Dense numbering by ``order``, a long unique within ``keys``."""
    df = running(df, order, {"_seq": Run("sum", F.lit(1).cast("long"))}, keys, width)
    return df.withColumn(name, F.col("_seq") + F.lit(start - 1)).drop("_seq")


def number_sorted(
    df: DataFrame, order: list[Column], name: str = "entry_id", start: int = 0, label: str = "sorted"
) -> DataFrame:
    """Sort by ``order`` (end it with unique columns) and number the rows densely.

    One range shuffle and one staged table. Offsets have a row per partition of the sort, which
    is what makes them safe to broadcast.
    """
    placed = df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    staged = stage(placed, label)
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(_UP, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        staged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_part", "_pos", "_offset")
    )
