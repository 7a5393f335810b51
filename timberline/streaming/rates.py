"""Smoothed line rate and stalls of live sources, by processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.operators.rates import ADD, KEEP, STALL_SECONDS

_OUT = "source_id string, lines long, rate double, idle_seconds long, stalled boolean"
_STATE = "rate double, second long, pending long, idle long"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count a task's lines per source before the shuffle."""
    for pdf in batches:
        yield pdf.groupby("source_id", dropna=False, as_index=False)["n"].sum()


def tick(rate: float, second: int, pending: int, idle: int, now: int, arrived: int):
    """Advance a source to second ``now``, to which ``arrived`` lines are added.

    Each finished second blends its lines into the rate; seconds without lines count as idle.
    """
    if now > second:
        rate = KEEP * rate + ADD * pending
        idle = 0 if pending else idle + 1
        gap = now - second - 1
        rate *= KEEP**gap
        idle += gap
        second, pending = now, 0
    return rate, second, pending + arrived, idle


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.getCurrentProcessingTimeMs() // 1000
    arrived = 0 if state.hasTimedOut else int(sum(pdf["n"].sum() for pdf in batches))
    held = state.get if state.exists else (0.0, now, 0, 0)
    rate, second, pending, idle = tick(*held, now, arrived)
    state.update((rate, second, pending, idle))
    # Wake up each second so that silence is seen.
    state.setTimeoutDuration(1000)
    yield pd.DataFrame(
        {
            "source_id": [key[0]],
            "lines": [arrived],
            "rate": [rate],
            "idle_seconds": [idle],
            "stalled": [idle >= STALL_SECONDS],
        }
    )


def rate_and_stall(stream: DataFrame) -> DataFrame:
    """Per source and trigger: lines, smoothed lines per second, idle seconds, stalled or not.

    State is four numbers per source. Lines are counted within tasks first, so that a source
    sending most of the lines shuffles one row per batch of rows, not each line.

    A timer per source fires every second to notice silence, so the query never runs out of
    work: give it a processing-time trigger, not ``availableNow``.
    """
    counts = stream.select("source_id", F.lit(1).cast("long").alias("n")).mapInPandas(
        _combine, "source_id string, n long"
    )
    return counts.groupBy("source_id").applyInPandasWithState(
        _update, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
