"""Live logs: sources, running summaries, pause and numbering.

Filters, parsing with a known format and merging are stateless, so the batch functions
(``apply_filter``, ``parse_logs(format=...)``, ``merge_streams``) take streams as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.formats import detect_format, formats, parse_logs
from timberline.operators.histogram import peak_shadows, retain_peaks, spikes
from timberline.operators.ordered import number_rows, number_sorted
from timberline.schema import ERROR, WARNING
from timberline.session import new_stage_path

WATERMARK = "10 minutes"


def stream_log_lines(
    spark: SparkSession, path: str, format: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """New files of a folder as a stream of ``(source_id, line_number, raw_line[, format])``.

    Each file is read once, as long as it is when listed: a growing file must be rotated, or be
    collected by something like Kafka, whose lines can be given the same columns. A rotated or
    re-created file is a new file. Lines carry no number; see :class:`LiveLog`.
    """
    reader = spark.readStream.schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.format("text").load(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.lit(None).cast("long").alias("line_number"),
        F.col("value").alias("raw_line"),
    )
    lines = lines.where(F.col("raw_line") != "")
    return lines if format is None else lines.withColumn("format", F.lit(format))


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the table's own schema; times without a zone are UTC."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern, the path may name one file as well as a folder.
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})


def to_table(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Run a stream over what there is now and return its result table.

    Appended rows go through the Parquet sink. In ``complete`` mode each batch writes the whole
    result to its own folder, so that a batch run again after a failure writes the same thing.
    """
    spark = stream.sparkSession
    root = new_stage_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    if mode != "complete":
        raise ValueError(mode)
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch={batch}")
        last.append(batch)

    writer.outputMode("complete").foreachBatch(write).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{root}/batch={last[-1]}")


def running_level_counts(stream: DataFrame) -> DataFrame:
    """Rows per level so far; complete or update mode."""
    return stream.groupBy("level").agg(F.count("*").alias("rows"))


def time_windows(stream: DataFrame, width: str, watermark: str | None = WATERMARK) -> DataFrame:
    """Severity counts per fixed window of ``width``, the base of a live histogram.

    Rows later than the watermark are dropped and show in the query's progress.
    """
    level = F.col("level")
    timed = stream.where(F.col("timestamp").isNotNull())
    if watermark and stream.isStreaming:
        timed = timed.withWatermark("timestamp", watermark)
    return (
        timed.groupBy(F.window("timestamp", width).alias("w"))
        .agg(
            F.count_if(level >= ERROR).alias("err"),
            F.count_if(level == WARNING).alias("warn"),
            F.count_if(level.isNull() | (level < WARNING)).alias("info"),
        )
        .select(
            F.unix_micros("w.start").alias("start_us"),
            F.unix_micros("w.end").alias("end_us"),
            "err",
            "warn",
            "info",
        )
    )


def live_bars(windows: DataFrame, buckets: int = 60) -> DataFrame:
    """At most ``buckets`` bars over the whole span, each a whole number of base windows."""
    ends = windows.agg(
        F.struct(
            F.min("start_us").alias("first"),
            F.max("end_us").alias("last"),
            F.max(F.col("end_us") - F.col("start_us")).alias("width"),
        ).alias("e")
    ).scalar()
    div = lambda a, b: F.call_function("div", a, b)
    every = windows.withColumn("_e", ends)
    first, width = F.col("_e.first"), F.col("_e.width")
    steps = div(F.col("_e.last") - first, width)
    step = div(steps + F.lit(buckets - 1), F.lit(buckets).cast("long")) * width
    counted = (
        every.withColumns({"_step": step, "bucket": div(F.col("start_us") - first, step).cast("int")})
        .groupBy("bucket")
        .agg(
            F.min(first).alias("_f"),
            F.min("_step").alias("_step"),
            *[F.sum(n).alias(n) for n in ("err", "warn", "info")],
        )
    )
    start = F.col("_f") + F.col("bucket") * F.col("_step")
    return counted.select(
        "bucket", start.alias("start_us"), (start + F.col("_step")).alias("end_us"), "err", "warn", "info",
        (F.col("err") + F.col("warn") + F.col("info")).alias("total"),
    )


class LiveHistogram:
    """``foreachBatch`` handler over :func:`time_windows` in complete mode.

    Each batch writes the bars now, the shadows of past peaks on them, and the peaks to remember:
    those of the bars about to be replaced are added first; with a ``cap`` the largest so many are kept.
    """

    def __init__(self, root: str, buckets: int = 60, cap: int | None = None):
        self.root, self.buckets, self.cap = root.rstrip("/"), buckets, cap

    def _path(self, part: str, batch: int) -> str:
        return f"{self.root}/{part}/batch={batch}"

    def __call__(self, windows: DataFrame, batch: int) -> None:
        spark = windows.sparkSession
        live_bars(windows, self.buckets).write.mode("overwrite").parquet(self._path("bars", batch))
        peaks = spark.createDataFrame([], "peak_us long, peak_count long")
        if batch > 0:
            before = spark.read.parquet(self._path("bars", batch - 1))
            known = spark.read.parquet(self._path("peaks", batch - 1))
            peaks = retain_peaks(known.unionByName(spikes(before)), self.cap)
        peaks.write.mode("overwrite").parquet(self._path("peaks", batch))
        bars, kept = (spark.read.parquet(self._path(p, batch)) for p in ("bars", "peaks"))
        peak_shadows(bars, kept).write.mode("overwrite").parquet(self._path("shadows", batch))


#: Held lines get places below those of a batch by so much; no batch has more lines.
HELD_FIRST = 1 << 60
#: Lines of a source that a task numbers, and then parses, together.
NUMBER_WIDTH = 1 << 16


class LiveLog:
    """``foreachBatch`` handler that parses, numbers and stores lines, and can be paused.

    While ``paused()`` is true lines are held back, raw; with a ``capacity`` only the last so many
    are kept and the dropped ones counted. The next batch that is not paused replays them first. Numbers
    continue from the rows so far, so drops leave no gap. ``order`` sorts the lines of a batch.

    Each batch writes its own folders from those of the batch before; one run again after a
    failure writes the same. With ``format=None`` the first lines let through of a source fix its
    format for good.
    """

    def __init__(
        self,
        root: str,
        order: Callable[[], list[Column]],
        format: str | None = None,
        paused: Callable[[], bool] = lambda: False,
        capacity: int | None = None,
        tz: str = "UTC",
        now=None,
    ):
        self.root, self.order, self.format = root.rstrip("/"), order, format
        self.paused, self.tz, self.now = paused, tz, now
        self.capacity = None if capacity is None else max(1, capacity)

    def _path(self, part: str, batch: int) -> str:
        return f"{self.root}/{part}/batch={batch}"

    def _before(self, spark: SparkSession, batch: int) -> tuple[int, int, int]:
        """Rows let through, lines dropped, and the batch that last wrote the sources (-1: none)."""
        if batch == 0:
            return 0, 0, -1
        row = spark.read.parquet(self._path("state", batch - 1)).first()
        return row["rows"], row["dropped"], row["sources"]

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        rows, dropped, known = self._before(spark, batch)
        if self.order:
            lines = number_sorted(lines, self.order(), "_at", 0, "batch")
        # Held lines come before this batch's: their places are below zero.
        held = spark.read.parquet(self._path("held", batch - 1)) if batch > 0 else None
        if held is not None and held.isEmpty():
            held = None
        if held is not None:
            lines = held.withColumn("_at", F.col("_at") - HELD_FIRST).unionByName(lines, allowMissingColumns=True)
        if self.order and held is None:
            # Sorted, staged and numbered from 0 already.
            waiting = lines.withColumn("_n", F.col("_at"))
        else:
            waiting = number_sorted(lines, [F.col("_at")], "_n", 0, "waiting")
        total = waiting.count()
        if self.paused():
            over = 0 if self.capacity is None else max(0, total - self.capacity)
            kept = waiting.where(F.col("_n") >= over).withColumn("_at", F.col("_n") - over).drop("_n")
            kept.write.mode("overwrite").parquet(self._path("held", batch))
            dropped += over
        else:
            numbered = waiting.withColumn("entry_id", F.col("_n") + rows).drop("_at", "_n", "line_number")
            self._parse(numbered, batch, known).write.mode("overwrite").parquet(self._path("rows", batch))
            waiting.where(F.lit(False)).drop("_n").write.mode("overwrite").parquet(self._path("held", batch))
            rows, dropped, known = rows + total, 0, batch
        state = spark.createDataFrame([(rows, dropped, known)], "rows long, dropped long, sources long")
        state.coalesce(1).write.mode("overwrite").parquet(self._path("state", batch))

    def _parse(self, lines: DataFrame, batch: int, known: int) -> DataFrame:
        """Records of lines with running numbers; headers are looked for by each source's own numbers."""
        spark = lines.sparkSession
        schema = "source_id string, format string, lines long"
        past = spark.createDataFrame([], schema)
        if known >= 0:
            past = spark.read.parquet(self._path("sources", known)).select(*past.columns)
        own = number_rows(lines, "entry_id", "line_number", keys=["source_id"], width=NUMBER_WIDTH)
        # Counted without their numbers.
        now = lines.groupBy("source_id").agg(F.count("*").alias("_now"))
        if self.format:
            now = now.withColumn("_format", F.lit(self.format))
        else:
            fresh = own.join(past.select("source_id"), "source_id", "left_anti")
            now = now.join(detect_format(fresh).select("source_id", F.col("format").alias("_format")), "source_id", "left")
        path = self._path("sources", batch)
        past.join(now, "source_id", "full").select(
            "source_id",
            F.coalesce("format", "_format").alias("format"),
            (F.coalesce("lines", F.lit(0)) + F.coalesce("_now", F.lit(0))).cast("long").alias("lines"),
            F.coalesce("lines", F.lit(0)).cast("long").alias("_past"),
        ).write.mode("overwrite").parquet(path)
        sources = spark.read.parquet(path)
        placed = own.drop("format").join(sources, "source_id", "left")
        placed = placed.withColumn("line_number", F.col("line_number") + F.col("_past")).drop("lines", "_past")
        # If all sources have the format that was named, first lines and the other formats aren't needed.
        named = any(f.name == self.format for f in formats()) and sources.where(~F.col("format").eqNullSafe(self.format)).isEmpty()
        parsed = parse_logs(placed, self.format if named else "column", self.tz, self.now)
        # A report's title isn't a line: it has no number.
        return parsed.withColumn("line_number", F.coalesce(F.col("entry_id") + 1, F.col("line_number")))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows let through so far."""
        return spark.read.option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows").drop("batch")

    def status(self, spark: SparkSession, batch: int) -> DataFrame:
        """``(rows, held, dropped)`` after a batch."""
        held = spark.read.parquet(self._path("held", batch)).count()
        return spark.read.parquet(self._path("state", batch)).withColumn("held", F.lit(held).cast("long"))
