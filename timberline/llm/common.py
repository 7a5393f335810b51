"""What several operators share: narrow inputs, staged tables and connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of so many two-long rows at most (32 MB) may be broadcast after it has been counted.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; one of its own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="timberline-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns of the input can't clash; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged, narrow) with a broadcast hint if its counted rows allow it, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def either(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def _stars(edges: DataFrame) -> bool:
    """Whether every node ``v`` hangs on one ``m`` alone, and no ``m`` hangs on another node."""
    hung, head = F.lit(1).alias("hung"), F.lit(1).alias("head")
    roles = edges.select(F.col("v").alias("node"), hung, F.lit(0).alias("head")).union(edges.select("m", F.lit(0), head))
    return roles.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("head").alias("head")).where("hung + head > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a long, b long).

    Large-star and small-star rounds: each halves the paths, each is two grouped minima and two
    joins on node ids, so a hub of any degree is pre-aggregated and its rows can be split. It ends
    when all that is left are stars, each a component. Nodes without an edge to another node are
    not in the result.
    """
    state = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    state = stage(state, "links")
    while not _stars(state):
        both = state.union(state.select(F.col("m").alias("v"), F.col("v").alias("m")))
        # Large star: every neighbour above u is hung on u's smallest neighbour (or u itself).
        least = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        large = (
            both.select(F.col("v").alias("u"), F.col("m").alias("w"))
            .where("w > u")
            .join(least, "u")
            .select(F.col("w").alias("v"), F.col("low").alias("m"))
            .where("v <> m")
        )
        # Small star: every neighbour below u, and u, is hung on the smallest of them.
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        hung = large.join(low, "v")
        small = (
            hung.select(F.col("m").alias("v"), F.col("low").alias("m"))
            .where("v <> m")
            .union(low.select("v", F.col("low").alias("m")))
            .distinct()
        )
        state = stage(small, "links")
    return state.select(F.col("v").alias("node"), F.col("m").alias("component"))
