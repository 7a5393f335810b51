"""Parsed logs as tables, and ingest of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.schema import LOG_COLUMNS
from timberline.session import path_exists, stage
from timberline.sources.files import open_logs

MTIME_TOLERANCE_US = 1_000


def write_log_table(df: DataFrame, path: str, mode: str = "overwrite", ranges: int | None = None) -> None:
    """Store log records as Parquet by day, sorted by time within files.

    Rows are spread by range of (day, time, line): files hold narrow time ranges, which lets
    time filters skip them, and a busy day or source is cut into as many files as it needs.
    """
    order = ["day", "timestamp", "source_id", "line_number"]
    dated = df.select(*LOG_COLUMNS).withColumn("day", F.to_date("timestamp"))
    spread = dated.repartitionByRange(ranges, *order) if ranges else dated.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def changed_files(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Catalog rows not in the manifest with the same size and, within 1 ms, modification time."""
    known = manifest.select(
        F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified")
    )
    drift = F.abs(F.unix_micros("modified") - F.unix_micros("_modified"))
    same = (
        (F.col("path") == F.col("_path"))
        & (F.col("size") == F.col("_size"))
        & (drift < MTIME_TOLERANCE_US)
    )
    return catalog.join(known, same, "left_anti")


MANIFEST = "path string, source_id string, size long, modified timestamp, generation long, format string, gone boolean"
#: Files that are read together, and written as one generation.
GROUP_FILES = 1000


def ingest_changed(
    spark: SparkSession, catalog: DataFrame, root: str, tz: str = "UTC", now=None, format: str = "auto", group_files: int = GROUP_FILES
) -> int:
    """Bring the table under ``root`` up to date with the catalogued files; returns files parsed.

    A file is parsed again when its size or time differs from the manifest, which covers growth,
    truncation and replacement; its old rows go, as do those of files no longer catalogued.

    Files are taken in groups of about ``group_files``. Each group's rows are a generation of their own, and
    a note of which files it holds, written last, makes them current: a run that dies midway keeps
    the groups it finished, changes nothing else, and the next run goes on with the rest. Readers never see
    half a file. :func:`compact_ingested` removes what is no longer current.
    """
    # Listed once: the folder may change meanwhile.
    catalog = stage(catalog.select("path", "source_id", "size", "modified"), "catalog")
    old = stage(current_files(spark, root), "current")
    todo = stage(changed_files(catalog, old), "changed")
    generation = _last_generation(spark, root)
    left = old.join(catalog.select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
    if not left.isEmpty():
        generation += 1
        _note(left.withColumn("generation", F.lit(generation).cast("long")), root, generation)
    files = todo.count()
    groups = -(-files // group_files)
    group = F.pmod(F.xxhash64("path"), F.lit(max(groups, 1)))
    for g in range(groups):
        mine = todo.where(group == g)
        paths = [r["path"] for r in mine.select("path").collect()]
        if not paths:
            continue
        generation += 1
        records, kinds = open_logs(spark, paths, format, tz, now)
        write_log_table(records, f"{root}/rows/generation={generation}")
        noted = mine.join(kinds.select("source_id", "format"), "source_id", "left").withColumns(
            {"generation": F.lit(generation).cast("long"), "gone": F.lit(False)}
        )
        _note(noted, root, generation)
    return files


def _note(files: DataFrame, root: str, generation: int, base: bool = False) -> None:
    """Write a part of the manifest; it counts once Spark marks it as complete."""
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    files.select(*columns).write.mode("overwrite").parquet(f"{root}/manifest/{generation:09d}{'b' if base else ''}")


def _notes(spark: SparkSession, root: str) -> list[str]:
    """Complete parts of the manifest in order, from the last one that stands for all before it."""
    if not path_exists(spark, f"{root}/manifest"):
        return []
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(
        s.getPath().getName() for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    )
    bases = [i for i, name in enumerate(done) if name.endswith("b")]
    return done[bases[-1] if bases else 0 :]


def _last_generation(spark: SparkSession, root: str) -> int:
    notes = _notes(spark, root)
    return int(notes[-1].rstrip("b")) if notes else 0


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """The files in the table under ``root``, and the generation that holds each one's rows."""
    notes = _notes(spark, root)
    if not notes:
        return spark.createDataFrame([], MANIFEST)
    parts = spark.read.schema(MANIFEST).parquet(*[f"{root}/manifest/{n}" for n in notes])
    latest = parts.groupBy("path").agg(F.max_by(F.struct(*[c for c in parts.columns if c != "path"]), "generation").alias("f"))
    return latest.select("path", "f.*").where(~F.col("gone")).select(*parts.columns)


def compact_ingested(spark: SparkSession, root: str) -> int:
    """Drop rows that are no longer current; returns generations removed.

    Rows still current in generations that hold others too are written as one new generation, then the
    manifest is written anew as a whole, and only then folders are removed. A run that dies before that changes
    nothing; one that dies while removing is made good by the next. Nobody may read meanwhile.
    """
    files = stage(current_files(spark, root), "current")
    last = _last_generation(spark, root)
    notes = _notes(spark, root)
    if not notes:
        return 0
    parts = spark.read.schema(MANIFEST).parquet(*[f"{root}/manifest/{n}" for n in notes])
    held = parts.where(~F.col("gone")).select("path", "generation").distinct()
    dead = held.join(files.select("path", "generation"), ["path", "generation"], "left_anti").select("generation").distinct()
    moved = stage(files.join(dead, "generation", "left_semi"), "moved")
    new = last + 1
    if not moved.isEmpty():
        rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
        rows = rows.join(moved.select("source_id", "generation"), ["source_id", "generation"], "left_semi")
        write_log_table(rows, f"{root}/rows/generation={new}")
    now = F.when(F.col("_moved"), F.lit(new).cast("long")).otherwise(F.col("generation"))
    marked = files.join(moved.select("path", F.lit(True).alias("_moved")), "path", "left")
    _note(marked.withColumn("generation", now), root, new, base=True)
    live = {f"generation={r.generation}" for r in current_files(spark, root).select("generation").distinct().collect()}
    removed = _remove_others(spark, f"{root}/rows", live)
    _remove_others(spark, f"{root}/manifest", {f"{new:09d}b"})
    return removed


def _remove_others(spark: SparkSession, folder: str, keep: set[str]) -> int:
    if not path_exists(spark, folder):
        return 0
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName() not in keep]
    for path in old:
        fs.delete(path, True)
    return len(old)


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    """Current rows of a table kept by :func:`ingest_changed`."""
    current = current_files(spark, root).select("source_id", "generation")
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.join(current, ["source_id", "generation"], "left_semi").drop("generation")
