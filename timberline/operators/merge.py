"""Several logs as one timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordered import number_sorted

_MERGED = {"merged_log": True}


def tag_source(df: DataFrame, source_id: str, rank: int = 0) -> DataFrame:
    """Rows with a time, marked with their source, its rank and their line there."""
    return df.where(F.col("timestamp").isNotNull()).withColumns(
        {
            "source_id": F.lit(source_id),
            "source_rank": F.lit(rank),
            "source_line_number": F.col("line_number"),
        }
    )


def _check(logs: dict[str, DataFrame]) -> None:
    if len(logs) < 2:
        raise ValueError("merging needs at least two logs")
    for name, df in logs.items():
        if df.schema["line_number"].metadata.get("merged_log"):
            raise ValueError(f"{name} is itself a merged log")


def merge_logs(logs: dict[str, DataFrame]) -> DataFrame:
    """All timed rows of the logs by time, renumbered from 1; ``entry_id`` from 0.

    Equal times keep the order of the logs given, then their lines. The full order is what rows
    are range-partitioned by, so one timestamp holding many rows is spread over partitions.
    """
    _check(logs)
    tagged = [tag_source(df, name, i) for i, (name, df) in enumerate(logs.items())]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = [F.col("timestamp"), F.col("source_rank"), F.col("source_line_number")]
    ranked = number_sorted(union.drop("entry_id", "line_number"), order, "entry_id", 0, "merged")
    columns = ["entry_id", "line_number"] + [
        c for c in union.columns if c not in ("entry_id", "line_number", "source_rank")
    ]
    return ranked.withColumn("line_number", F.col("entry_id") + 1).select(
        *[F.col(c).alias(c, metadata=_MERGED) if c == "line_number" else F.col(c) for c in columns]
    )


def merge_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Live merge: timed rows of all streams, tagged, in arrival order."""
    _check(streams)
    tagged = [tag_source(df, name, i) for i, (name, df) in enumerate(streams.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).drop("source_rank")


def back_to_source(merged: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Merged rows joined to the rows they came from; those get the prefix ``origin_``.

    The key (source, line) is unique on both sides, so no source is a hot key.
    """
    union = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("source_id", F.lit(name)) for name, df in logs.items()],
    )
    origin = union.select(*[F.col(c).alias(f"origin_{c}") for c in union.columns])
    return merged.join(
        origin,
        (merged["source_id"] == origin["origin_source_id"])
        & (merged["source_line_number"] == origin["origin_line_number"]),
    )


def source_list(merged: DataFrame) -> DataFrame:
    """``(source_id)`` of a merged log, by name."""
    return merged.select("source_id").distinct().orderBy("source_id")


def merge_label(names: list[str]) -> str:
    """Up to three names joined by ``+``; of more, two and how many more."""
    if len(names) <= 3:
        return " + ".join(names)
    return f"{' + '.join(names[:2])} + {len(names) - 2} more"
