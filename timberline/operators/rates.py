"""Line rate, stalls and paused ingestion, over stored arrivals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.operators.ordered import Run, keyed, number_rows, running

# Fixed values.
KEEP, ADD = 0.6, 0.4
STALL_SECONDS = 5
MIN_SHOWN_RATE = 0.5

#: Seconds in a block. Powers of the decay over a block stay far inside a double's range.
_BLOCK = 512


def _rated(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Per second with lines: lines, rate, the second with lines before and the one after.

    Lines are counted per second before anything is shuffled. In a block of seconds the average is a running
    sum of counts, each raised by what it decays to the end of the block; a block hands on its last rate.
    """
    second = F.floor(F.unix_micros(time) / 1_000_000).cast("long")
    counts = df.where(F.col(time).isNotNull()).groupBy(*keys, second.alias("second")).agg(F.count("*").alias("lines"))
    counts = counts.withColumn("_block", F.col("second") - F.pmod("second", F.lit(_BLOCK).cast("long")))
    counts, on = keyed(counts, keys)
    at = F.col("second") - F.col("_block")
    raised = F.col("lines") * ADD * F.pow(F.lit(KEEP), -at)
    blocks = counts.groupBy(*on, "_block").agg(
        (F.sum(raised) * KEEP ** (_BLOCK - 1)).alias("_end"), F.min("second").alias("_first"), F.max("second").alias("_last")
    )
    carried = blocks.groupBy(*on).applyInArrow(_carried, T.StructType([blocks.schema[c] for c in [*on, "_block"]]).add("_rate", "double").add("_before", "long").add("_after", "long"))
    in_block = Window.partitionBy(*on, "_block").orderBy("second")
    rows = counts.withColumns(
        {
            "_own": F.pow(F.lit(KEEP), at) * F.sum(raised).over(in_block.rowsBetween(Window.unboundedPreceding, 0)),
            "_lag": F.lag("second").over(in_block),
            "_lead": F.lead("second").over(in_block),
        }
    )
    return rows.join(carried, [*on, "_block"]).select(
        *keys, "second", "lines", (F.col("_own") + F.col("_rate") * F.pow(F.lit(KEEP), at + 1)).alias("rate"),
        F.coalesce("_lag", "_before").alias("_before"), F.coalesce("_lead", "_after").alias("_after"),
    )


def _carried(table: pa.Table) -> pa.Table:
    """What each block of a source starts from: the rate in the second before it, the last second with lines
    before it and the first one after it. A row per 512 seconds, however many lines there are."""
    table = table.sort_by("_block")
    block, end = table.column("_block").to_pylist(), table.column("_end").to_pylist()
    rates, rate, until = [], 0.0, block[0]
    for b, own in zip(block, end):
        rates.append(rate * KEEP ** (b - until))
        rate, until = rates[-1] * KEEP**_BLOCK + own, b + _BLOCK
    none = pa.nulls(1, pa.int64())
    before = pa.chunked_array([none, *table.column("_last").slice(0, len(block) - 1).chunks])
    after = pa.chunked_array([*table.column("_first").slice(1).chunks, none])
    return table.drop_columns(["_end", "_first", "_last"]).append_column("_rate", pa.array(rates)).append_column("_before", before).append_column("_after", after)


def line_rates(df: DataFrame, time: str = "timestamp", keys: list[str] | None = None) -> DataFrame:
    """Per second with lines: count, smoothed rate, and idle seconds and stall just before it.

    The rate follows ``0.6 × previous + 0.4 × lines`` every second, idle ones included, from the first
    line on. Rows without a time don't count.
    """
    keys = keys or []
    idle = F.coalesce(F.col("second") - F.col("_before") - 1, F.lit(0).cast("long"))
    return _rated(df, time, keys).select(
        *keys, "second", "lines", "rate", idle.alias("idle_before"), (idle >= STALL_SECONDS).alias("stalled_before")
    )


def rate_seconds(df: DataFrame, time: str = "timestamp", keys: list[str] | None = None, until: Column | None = None) -> DataFrame:
    """Every second from the first line to the last: count, smoothed rate, idle seconds so far, stalled or not.

    ``until``, a time, goes on after the last line, so that a source that has fallen silent shows as stalled;
    it may differ by key. The result has a row per second of the span.
    """
    keys = keys or []
    rated = _rated(df, time, keys)
    last = F.col("second") if until is None else F.greatest(F.col("second"), F.floor(F.unix_micros(until) / 1_000_000).cast("long"))
    each = F.explode(F.sequence("second", F.coalesce(F.col("_after") - 1, last)))
    seconds = rated.select(*keys, F.col("second").alias("_from"), "lines", "rate", each.alias("second"))
    idle = F.col("second") - F.col("_from")
    return seconds.select(
        *keys, "second", F.when(idle == 0, F.col("lines")).otherwise(F.lit(0)).cast("long").alias("lines"),
        (F.col("rate") * F.pow(F.lit(KEEP), idle)).alias("rate"), idle.alias("idle_seconds"), (idle >= STALL_SECONDS).alias("stalled"),
    )


def shown_rate(rate: Column) -> Column:
    """The rate as displayed: hidden below half a line per second."""
    return F.when(rate >= MIN_SHOWN_RATE, rate)


def pause_state(df: DataFrame, order: str, pause: Column, resume: Column) -> DataFrame:
    """Add ``paused`` and ``pause_id`` from control rows in the same arrival order.

    A pause lasts until the next resume; pausing again meanwhile changes nothing.
    """
    control = F.when(pause, F.lit(1)).when(resume, F.lit(0))
    out = running(
        df,
        order,
        {
            "_state": Run("last", control, inclusive=False),
            "_resumes": Run("sum", F.when(resume, 1).otherwise(0).cast("long"), inclusive=False),
        },
    )
    paused = F.coalesce(F.col("_state") == 1, F.lit(False))
    return out.withColumns({"paused": paused, "pause_id": F.when(paused, F.col("_resumes"))}).drop(
        "_state", "_resumes"
    )


def pause_buffer(
    df: DataFrame, order: str, capacity: int | None = None, stopped: Column | None = None
) -> DataFrame:
    """Lines that get through, numbered in arrival order as ``live_number``.

    All lines of a pause are replayed; with a ``capacity`` the last so many, and the older ones are
    dropped. Lines of a ``stopped`` pause are all discarded. Expects ``paused`` and ``pause_id``.
    """
    kept = df
    if capacity is not None:
        last = F.col("_from_end") <= max(1, capacity)
        kept = _ranked_from_end(df, order).where(~F.col("paused") | last).drop("_from_end")
    if stopped is not None:
        kept = kept.where(~(F.col("paused") & F.coalesce(stopped, F.lit(False))))
    return number_rows(kept, order, "live_number")


def pause_drops(df: DataFrame, capacity: int | None = None) -> DataFrame:
    """``(pause_id, buffered, dropped)`` per pause that saw lines; without a capacity none drops."""
    held = df.where("paused").groupBy("pause_id").agg(F.count("*").alias("_n"))
    if capacity is None:
        return held.select("pause_id", F.col("_n").alias("buffered"), F.lit(0).cast("long").alias("dropped"))
    capacity = max(1, capacity)
    return held.select(
        "pause_id",
        F.least("_n", F.lit(capacity).cast("long")).alias("buffered"),
        F.greatest(F.col("_n") - capacity, F.lit(0).cast("long")).alias("dropped"),
    )


def _ranked_from_end(df: DataFrame, order: str) -> DataFrame:
    df = df.withColumn("_back", -F.col(order))
    ranked = number_rows(df, "_back", "_from_end", keys=["pause_id"])
    return ranked.drop("_back")
