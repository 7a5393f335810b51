"""What log and report files a folder holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import list_in_few_tasks

# File kinds and report name prefixes.
REPORT_EXTENSIONS = ["ips", "crash", "diag", "spin", "hang"]
SPIN_PREFIXES = ["Spin", "StackShot", "Hang"]
DIAGNOSTIC_PREFIXES = ["JetsamEvent", "ExcUserFault", "wakeups", "WakeUp", "CPU", "HighCPU"]


def file_category(name: Column) -> Column:
    """``log``, ``crash``, ``diagnostic`` or ``spin``; null for other files."""
    low = F.lower(name)
    extension = F.regexp_extract(low, r"\.([^.]*)$", 1)
    log = low.rlike(r"\.(?:log|txt)$") | low.rlike(r"\.log.*\.gz$") | low.rlike(r"\.txt\.gz$")
    return (
        F.when(log, F.lit("log"))
        .when(~extension.isin(*REPORT_EXTENSIONS), F.lit(None).cast("string"))
        .when(extension.isin("spin", "hang"), F.lit("spin"))
        .when(extension == "diag", F.lit("diagnostic"))
        .when(name.rlike("^(?:" + "|".join(SPIN_PREFIXES) + ")"), F.lit("spin"))
        .when(name.rlike("^(?:" + "|".join(DIAGNOSTIC_PREFIXES) + ")"), F.lit("diagnostic"))
        .otherwise(F.lit("crash"))
    )


def log_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, name, size, modified, category, source_id)`` of the folders' own non-empty, visible
    log and report files, newest first. Contents are not read. ``source_id`` is what lines read
    from the file carry.
    """
    list_in_few_tasks(spark)
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(
            "path",
            name.alias("name"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
            F.col("_metadata.file_path").alias("source_id"),
        )
        .withColumn("category", file_category(F.col("name")))
        .where((F.col("size") > 0) & ~F.col("name").startswith(".") & F.col("category").isNotNull())
        .orderBy(F.desc("modified"), "path")
    )
