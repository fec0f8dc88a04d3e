"""A corpus from raw documents: the stages in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  ``run`` writes each stage's rows to the shared folder and reads them again.

Edge cases, in every stage: an empty table gives an empty one; columns the stage does not name, nulls in them
and their names stay as they are; rows that repeat others stay rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import _store, decontaminate, mix_budget, odd_minhash, quality_cnn, tiered_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.5 or more; it learns from two thirds of the labels.

    Null and empty texts are scored as an all-zero document, long ones whole; rows alike score alike; a document
    without a label or an id is scored as any other; without labels of both classes all get one score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    net = quality_cnn.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality_cnn.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The smallest doc_id stays, with all rows that have it; texts without words, null ones included, are like
    nothing and stay, and so do rows without a doc_id."""
    return odd_minhash.dedup(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Each row is judged by its own text: null and empty ones are clean; a text shorter than an item is one
    window; rows alike go or stay together; an empty benchmark leaves all."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: each document as often as the mix takes it.

    Null and empty texts are never taken; a null source is a source of its own; rows that repeat others count
    one by one, and which of those that are alike in id, source and text are taken makes no difference."""
    return mix_budget.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as shards, read back: the columns of documents and the shard of each row.

    All rows and values are kept; if documents have a column ``shard``, the new one is ``shard_``."""
    return tiered_shards.shard(docs).select("doc.*", F.col("shard").alias(tiered_shards.unused("shard", docs.columns)))


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier, the hashes and the knapsack have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _store.work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = _store.saved(stage(spark, docs, sf_dir), f"{path}/{i}")
        _store.remove(spark, f"{path}/{i - 1}")
    return docs
