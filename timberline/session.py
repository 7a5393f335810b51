"""Session defaults and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks to list folders with, if nobody sets them.
UNSET_LISTING = "10000"


def get_session(app: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with a UTC clock and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Building plans column by column is several times faster without call-site capture.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prefer_compiled(spark: SparkSession) -> None:
    """Let wide projections run as several small methods.

    The Java VM does not compile methods above 8000 bytes of bytecode, which a parse with all its
    columns exceeds when fused into one; it then runs about three times slower. Left alone if set.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8000")


def list_in_few_tasks(spark: SparkSession) -> None:
    """List many folders in a few tasks for each core.

    Spark's own setting gives each of up to 10,000 folders a task, which costs far more than the listing. Left alone if set.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(key) == UNSET_LISTING:
        spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan with fewer splits than cores: a small table, or files that cannot be split.

    Meant for scans, before costly work per row. A scan with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is set (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="timberline-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def new_stage_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, so that a lost executor never recomputes it and every later pass sees the
    same rows, partition numbers and row order.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
