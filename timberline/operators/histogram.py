"""Equal-width time histograms, spikes, shadows of past spikes, and rows that stand for a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.schema import ERROR, WARNING
from timberline.session import stage

# Fixed values.
BUCKETS = 60
MIN_ROWS = 10
MIN_TIMED_SHARE = 0.1
SPIKE_MULTIPLIER = 3.0
SPIKE_FLOOR = 5
DAY_US = 86_400_000_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def time_span(df: DataFrame) -> DataFrame:
    """One row: row counts, first and last µs; the span is null where a histogram makes no sense."""
    us = F.unix_micros("timestamp")
    stats = df.agg(
        F.count("*").alias("rows"),
        F.count("timestamp").alias("timed"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
    )
    fit = (
        (F.col("rows") >= MIN_ROWS)
        & (F.col("timed") / F.col("rows") >= MIN_TIMED_SHARE)
        & (F.col("last_us") > F.col("first_us"))
    )
    return stats.withColumn("span_us", F.when(fit, F.col("last_us") - F.col("first_us")))


def _span(df: DataFrame) -> Column:
    """The span as a scalar subquery: one small job, no join."""
    return time_span(df).select(F.struct("first_us", "span_us").alias("s")).scalar()


def bucket_of(us: Column, first_us: Column, span_us: Column, buckets: int) -> Column:
    """Bucket of a time, in exact integers; times at the end fall in the last bucket."""
    at = _div((us - first_us) * F.lit(buckets).cast("long"), span_us)
    return F.least(F.lit(buckets - 1).cast("long"), F.greatest(F.lit(0).cast("long"), at)).cast("int")


def bucket_start(bucket: Column, first_us: Column, span_us: Column, buckets: int) -> Column:
    """First µs of a bucket."""
    edge = bucket.cast("long") * span_us
    return first_us + _div(edge + F.lit(buckets - 1), F.lit(buckets).cast("long"))


def bucket_center(bucket: Column, first_us: Column, span_us: Column, buckets: int) -> Column:
    return first_us + _div((bucket.cast("long") * 2 + 1) * span_us, F.lit(2 * buckets).cast("long"))


def _frame(df: DataFrame, buckets: int) -> DataFrame:
    """All bucket numbers."""
    return df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))


def add_bucket(df: DataFrame, buckets: int = BUCKETS, name: str = "bucket") -> DataFrame:
    """Add the histogram bucket of each row; null without a timestamp or without a histogram."""
    span = _span(df)
    us = F.unix_micros("timestamp")
    return df.withColumn(name, F.when(us.isNotNull(), bucket_of(us, span["first_us"], span["span_us"], buckets)))


def histogram(df: DataFrame, buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """``(bucket, start_us, end_us, err, warn, info, total)``, empty buckets included.

    The span is found before rows are counted, so ``df`` is evaluated twice; where that is costly, as
    with lines still to be parsed, ``once`` writes times and levels to the staging folder and reads these.

    No rows at all when the log is too short, mostly untimed, or has a single time. Rows are
    counted per bucket before the shuffle, so a bucket holding most of them costs nothing extra.
    """
    if once:
        df = stage(df.select("timestamp", "level"), "histogram")
    level, span = F.col("level"), _span(df)
    counted = (
        add_bucket(df, buckets)
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(
            F.count_if(level >= ERROR).alias("err"),
            F.count_if(level == WARNING).alias("warn"),
            F.count_if(level.isNull() | (level < WARNING)).alias("info"),
        )
    )
    zero = F.lit(0).cast("long")
    empty = _frame(df, buckets).select("bucket", *[zero.alias(n) for n in ("err", "warn", "info")])
    rows = (
        counted.unionByName(empty)
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in ("err", "warn", "info")])
        .withColumn("_s", span)
        .where(F.col("_s.span_us").isNotNull())
    )
    first, width = F.col("_s.first_us"), F.col("_s.span_us")
    return rows.select(
        "bucket",
        bucket_start(F.col("bucket"), first, width, buckets).alias("start_us"),
        bucket_start(F.col("bucket") + 1, first, width, buckets).alias("end_us"),
        "err",
        "warn",
        "info",
        (F.col("err") + F.col("warn") + F.col("info")).alias("total"),
    )


def histogram_summary(df: DataFrame, buckets: int = BUCKETS, shadows: DataFrame | None = None) -> DataFrame:
    """One row: start and end labels, first µs, bucket width in µs, tallest bar or shadow."""
    bars = histogram(df, buckets).agg(F.max("total").alias("max_total")).where("max_total IS NOT NULL")
    if shadows is not None:
        tallest = shadows.agg(F.max("peak_count").alias("m")).scalar()
        bars = bars.withColumn("max_total", F.greatest("max_total", tallest))
    span = _span(df)
    first = F.timestamp_micros(span["first_us"])
    last = F.timestamp_micros(span["first_us"] + span["span_us"])

    def label(ts: Column) -> Column:
        return F.when(span["span_us"] > DAY_US, F.date_format(ts, "MMM d HH:mm")).otherwise(
            F.date_format(ts, "HH:mm:ss")
        )

    return bars.select(
        label(first).alias("start_label"),
        label(last).alias("end_label"),
        span["first_us"].alias("first_us"),
        (span["span_us"] / F.lit(float(buckets))).alias("bucket_us"),
        "max_total",
    )


def spikes(bars: DataFrame, multiplier: float = SPIKE_MULTIPLIER, floor: int = SPIKE_FLOOR) -> DataFrame:
    """``(peak_us, peak_count)`` of bars above ``max(floor, multiplier × median of filled bars)``.

    Takes a histogram, so the window here sees one row per bucket.
    """
    every = Window.partitionBy(F.lit(0))
    median = F.median(F.when(F.col("total") > 0, F.col("total"))).over(every)
    first = F.min("start_us").over(every)
    last = F.max("end_us").over(every)
    count = F.count("*").over(every)
    return (
        bars.select("bucket", "total", median.alias("_m"), first.alias("_f"), last.alias("_l"), count.alias("_n"))
        .where(F.col("total") > F.greatest(F.lit(float(floor)), F.col("_m") * multiplier))
        .select(
            (
                F.col("_f")
                + _div((F.col("bucket").cast("long") * 2 + 1) * (F.col("_l") - F.col("_f")), F.col("_n") * 2)
            ).alias("peak_us"),
            F.col("total").alias("peak_count"),
        )
    )


def retain_peaks(peaks: DataFrame, cap: int | None = None) -> DataFrame:
    """All peaks, or the ``cap`` largest; the earlier of equal ones."""
    return peaks if cap is None else peaks.orderBy(F.desc("peak_count"), F.asc("peak_us")).limit(cap)


def peak_shadows(bars: DataFrame, peaks: DataFrame) -> DataFrame:
    """``(bucket, peak_count)`` where a retained peak is higher than the bar now at its time."""
    every = Window.partitionBy(F.lit(0))
    edges = bars.select(
        "bucket",
        "total",
        F.min("start_us").over(every).alias("_f"),
        F.max("end_us").over(every).alias("_l"),
        F.count("*").over(every).alias("_n"),
    )
    frame = edges.select(F.struct(F.first("_f").alias("f"), F.first("_l").alias("l"), F.first("_n").alias("n"))).scalar()
    at = peaks.select("peak_us", "peak_count", frame.alias("_e")).where(
        (F.col("peak_us") >= F.col("_e.f")) & (F.col("peak_us") < F.col("_e.l"))
    )
    tallest = (
        at.select(
            _div((F.col("peak_us") - F.col("_e.f")) * F.col("_e.n"), F.col("_e.l") - F.col("_e.f"))
            .cast("int")
            .alias("bucket"),
            "peak_count",
        )
        .groupBy("bucket")
        .agg(F.max("peak_count").alias("peak_count"))
    )
    return (
        bars.join(tallest, "bucket")
        .where(F.col("peak_count") > F.col("total"))
        .select("bucket", "peak_count")
    )


def bucket_representatives(
    df: DataFrame, visible: Column | None = None, buckets: int = BUCKETS, order: str = "entry_id", keys=("source_id",)
) -> DataFrame:
    """``(bucket, *keys, target, rolled)``: the row that stands for each bucket of all rows.

    ``target`` is the row's ``order`` within its ``keys``; rows are in the order of both, file by file.

    The first visible error or critical row of the bucket if the log has any there, else the
    first visible warning likewise, else the first visible row at or after the bucket's start in
    row order; ``rolled`` says that row lies past the bucket. One aggregation over the rows.
    """
    shown = F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))
    level, row = F.col("level"), F.struct(*keys, F.col(order).alias("_row"))
    placed = add_bucket(df.withColumn("_shown", shown), buckets).where(F.col("bucket").isNotNull())
    found = placed.groupBy("bucket").agg(
        F.min(F.when(F.col("_shown") & (level >= ERROR), row)).alias("_err"),
        F.min(F.when(F.col("_shown") & (level == WARNING), row)).alias("_warn"),
        F.min(F.when(F.col("_shown"), row)).alias("_any"),
    )
    filled = (
        found.unionByName(_frame(df, buckets), allowMissingColumns=True)
        .groupBy("bucket")
        .agg(*[F.min(n).alias(n) for n in ("_err", "_warn", "_any")])
    )
    # One row per bucket from here on.
    ahead = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    following = F.min(F.when(F.col("_any").isNotNull(), F.struct("_any", "bucket"))).over(ahead)
    severe = F.coalesce("_err", "_warn")
    return (
        filled.select("bucket", severe.alias("_severe"), following.alias("_next"))
        .select(
            "bucket",
            F.coalesce("_severe", "_next._any").alias("_target"),
            (F.col("_severe").isNull() & (F.col("_next.bucket") > F.col("bucket"))).alias("rolled"),
        )
        .where(F.col("_target").isNotNull())
        .select("bucket", *[F.col("_target")[k].alias(k) for k in keys], F.col("_target._row").alias("target"), "rolled")
    )


def first_in_ranges(
    df: DataFrame,
    ranges: list[tuple[int, int]],
    levels: list[int] | None = None,
    visible: Column | None = None,
    order: str = "entry_id",
    keys=("source_id",),
) -> DataFrame:
    """``(*keys, range_id, start_us, end_us, first_row)``: the first row of a file with a time in
    ``[start, end)`` µs, a level among ``levels`` and ``visible``. All ranges in one pass. Files
    without any row of the levels have no rows here.
    """
    us = F.unix_micros("timestamp")
    ok = F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))
    if levels is not None:
        ok = ok & F.col("level").isin(*levels)
    found = df.where(ok).groupBy(*keys).agg(
        *[F.min(F.when((us >= a) & (us < b), F.col(order))).alias(f"_{i}") for i, (a, b) in enumerate(ranges)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("range_id"),
            F.lit(a).cast("long").alias("start_us"),
            F.lit(b).cast("long").alias("end_us"),
            F.col(f"_{i}").alias("first_row"),
        )
        for i, (a, b) in enumerate(ranges)
    ]
    return found.select(*keys, F.inline(F.array(*rows)))
