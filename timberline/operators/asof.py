"""Matching the rows of one log to those of another by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordered import Run, running

# Distinct microseconds are windowed by second, so no window exceeds a million rows.
SECOND = 1_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    payload: list[str],
    left_time: str = "timestamp",
    right_time: str = "timestamp",
    right_order: str = "entry_id",
    prefix: str = "near_",
    fallback: bool = True,
) -> DataFrame:
    """Each ``left`` row with ``payload`` of the last ``right`` row at or before its time.

    Of equal times the last in ``right_order`` wins. Rows before all of ``right`` get its first
    timed row (``fallback``) or null; rows without a time get null.

    Both sides are first reduced to their distinct microseconds, which takes the skew out of hot
    timestamps; carrying values forward then works on one row per microsecond. The result meets
    ``left`` again in an equi-join on the microsecond, whose right side is unique, so that
    adaptive execution can split a hot left key.
    """
    value = F.struct(F.col(right_order).alias("_o"), *payload)
    timed = right.where(F.col(right_time).isNotNull())
    marks = timed.select(F.unix_micros(right_time).alias("_at"), value.alias("_mark"))
    probes = left.where(F.col(left_time).isNotNull()).select(
        F.unix_micros(left_time).alias("_at"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark")
    )
    instants = probes.unionByName(marks).groupBy("_at").agg(F.max("_mark").alias("_mark"))
    carried = running(instants, "_at", {"_match": Run("last", F.col("_mark"))}, width=SECOND)
    carried = carried.select(F.col("_at").alias("_key"), "_match")

    out = left.withColumn("_at", F.unix_micros(left_time))
    out = out.join(carried, out["_at"] == carried["_key"], "left")
    match = F.col("_match")
    if fallback:
        first = timed.agg(F.min(value).alias("_first")).scalar()
        match = F.when(F.col("_at").isNotNull(), F.coalesce(match, first))

    def picked(name: str) -> Column:
        return F.col("_pick")[name].alias(prefix + name)

    return out.withColumn("_pick", match).select(
        *[out[c] for c in left.columns], *[picked(n) for n in payload]
    )
