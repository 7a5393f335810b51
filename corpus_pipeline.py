"""The corpus pipeline: documents in, packed sequences of clean, distinct, masked text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import checked_broadcast, stage
from timberline.llm.jaccard import similar_documents
from timberline.llm.line_runs import drop_repeated_lines
from timberline.llm.packing import pack_documents
from timberline.llm.pii import mask_pii
from timberline.llm.quality import quality_rules


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2): whole rows as a struct, so that no name can clash, and two hashes of all they hold."""
    row = F.struct(*docs.columns)
    return docs.select(row.alias("row"), F.xxhash64(row).alias("k1"), F.xxhash64(F.lit(1), row).alias("k2"))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``_keyed`` but for those whose keys (k1, k2) are among ``keys``."""
    gone = stage(keys.select("k1", "k2").distinct(), "gone")
    return rows.join(checked_broadcast(gone), ["k1", "k2"], "left_anti")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as long as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each row by its own text and host, whatever its id."""
    rows = _keyed(docs)
    judged = quality_rules(rows.select("row.doc_id", "row.text", "row.source", "k1", "k2"), keys=("k1", "k2"))
    return _without(rows, judged.where(~F.col("kept"))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more go, and documents of nothing else."""
    return _measured(drop_repeated_lines(docs, min_words=50))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays: the one with the smallest id, ids before none.

    Rows are told apart by all they hold, so copies that repeat an id, or have none, are copies like
    others; of rows that are equal in everything one stays. Rows without a word are alike to none.
    """
    rows = _keyed(docs)
    ids = stage(rows.select(F.col("row.doc_id").alias("id"), "k1", "k2").distinct(), "ids")
    found = similar_documents(rows.select("k1", "row.text"), id_col="k1").select(F.col("doc_id").alias("k1"), "component_id", "n_shingles")
    found = stage(found.where("n_shingles > 0").distinct().join(ids, "k1"), "found")
    order = F.struct(F.col("id").isNull(), "id", "k1", "k2")
    first = found.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = found.join(first, "component_id").where(order != F.col("first"))
    left = _without(rows, gone)
    # Equal rows with words: only those that occur again are moved.
    again = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(found, ["k1", "k2"], "left_semi")
    again = checked_broadcast(stage(again.select("k1", "k2"), "again"))
    twice = left.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return left.join(again, ["k1", "k2"], "left_anti").unionByName(twice).select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _measured(mask_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packing),
]

#: Encoding by a vocabulary file has no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
