"""The first lines of files, without reading the files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import list_in_few_tasks
from timberline.sources.bytes import first_lines

HEADS = "source_id string, line_number long, raw_line string"


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, source_id, size)`` of files; contents are not read, and tasks follow file sizes."""
    list_in_few_tasks(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("_metadata.file_path").alias("source_id"), F.col("length").alias("size"))


def heads_of(files: DataFrame, lines: int = 50) -> DataFrame:
    """``(source_id, line_number, raw_line)``: the first ``lines`` lines of listed files (path, source_id).

    Each task opens its files and stops reading after these lines; gzip files are unpacked as far.
    Line ends are those of Spark's text reader, numbers are physical lines from 1, empty lines are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source_id").to_pylist()):
                head = first_lines(path, lines)
                kept = [(i + 1, line.decode("utf-8", "replace")) for i, line in enumerate(head) if line]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())],
                    names=["source_id", "line_number", "raw_line"],
                )

    return files.select("path", "source_id").mapInArrow(run, HEADS)


def read_heads(spark: SparkSession, path: str | list[str], lines: int = 50) -> DataFrame:
    """The first lines of the files under ``path``; see :func:`heads_of`."""
    return heads_of(file_list(spark, path), lines)
