"""Reading log lines with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.session import list_in_few_tasks

_MASK = (1 << 33) - 1
#: The block table is sent to all tasks up to so many rows of five longs (40 MB); beyond, lines are joined to it.
SENT_BLOCKS = 1_000_000


def _most_blocks(text: DataFrame) -> int:
    """No fewer than there are blocks: each split begins one, and so does each file."""
    return text.rdd.getNumPartitions() + len(text.inputFiles())


def _pin_splits(spark: SparkSession) -> None:
    """Fix how files are cut, so that both passes of one read see the same blocks.

    Unless set, the cut follows the number of cores at hand, which may change between passes.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def read_log_lines(spark: SparkSession, path: str | list[str], keep_empty: bool = False) -> DataFrame:
    """``(source_id, line_number, entry_id, raw_line)`` of text files, plain or gzip.

    ``line_number`` is the physical line, from 1 per file. Empty lines are dropped but counted;
    ``entry_id`` numbers the lines that remain, from 0 per file.

    Reading order within a file block gives a line's place in the block; a table with one row per block, known by a
    hash of its file and place, gives the lines before the block. It is sent to all tasks, so that lines don't
    move, up to ``SENT_BLOCKS``; their number is bounded before anything runs. Gzip files are one block.
    """
    _pin_splits(spark)
    list_in_few_tasks(spark)
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_key"),
        F.col("value").alias("raw_line"),
        F.monotonically_increasing_id().alias("_at"),
    )
    kept = F.lit(True) if keep_empty else F.col("raw_line") != ""
    blocks = text.groupBy("source_id", "_block", "_key").agg(
        F.count("*").alias("_lines"),
        F.count_if(kept).alias("_kept"),
        F.min("_at").alias("_from"),
    )
    in_file = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks read by the same task share one counter of kept lines.
    in_task = (
        Window.partitionBy(F.shiftright("_from", 33)).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    starts = blocks.select(
        "_key",
        "_from",
        "_lines",
        F.coalesce(F.sum("_lines").over(in_file), zero).alias("_lines_before"),
        F.coalesce(F.sum("_kept").over(in_file), zero).alias("_kept_before"),
        F.coalesce(F.sum("_kept").over(in_task), zero).alias("_kept_in_task"),
    )
    rows = text.where(kept).withColumn("_kept_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_MASK)))
    if _most_blocks(text) <= SENT_BLOCKS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, "_key", "left")
    offset = F.col("_at") - F.col("_from")
    moved = F.raise_error(F.lit("file splits changed between passes; set spark.sql.files.minPartitionNum"))
    return placed.select(
        "source_id",
        F.when((offset >= 0) & (offset < F.col("_lines")), F.col("_lines_before") + offset + 1)
        .otherwise(moved.cast("long"))
        .alias("line_number"),
        (F.col("_kept_before") + F.col("_kept_at") - F.col("_kept_in_task")).alias("entry_id"),
        "raw_line",
    )
