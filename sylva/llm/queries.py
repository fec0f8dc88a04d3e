"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, decontaminate, line_runs, mix_budget, odd_minhash, quality_cnn, rank_profiles, rindex_dedup, rule_lists, sql, tiered_shards, token_arrow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(column: str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(_crc("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    net = quality_cnn.train(documents, labels)
    out = quality_cnn.score(documents, net)
    return out.select("doc_id", (_crc("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept", "spans")


def op3_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_arrow.tokenized(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiered_shards.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "shard", "shard_bytes", F.octet_length(F.col("doc.text")).cast("long").alias("n_bytes"), F.crc32(F.col("doc.text").cast("binary")).alias("text_crc32"))


def op7_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    profiles = rank_profiles.learn(documents.filter(_crc("doc_id", 5) != 0))
    out = rank_profiles.identify(documents, profiles)
    return out.select("doc_id", (_crc("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _store.saved(rule_lists.statistics(_table(spark, sf_dir, "documents")), _store.work_dir(spark, "stats"))
    labels = _table(spark, sf_dir, "labels").filter(_crc("doc_id", 3) != 1)
    rules = rule_lists.fit(stats, labels.select(F.col("doc_id").cast("long"), (F.col("quality") == 0).alias("bad")))
    return rule_lists.judge(stats, rules)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_budget.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {f.__name__: f for f in (op1_quality_cnn, op2_run_index, op3_token_arrow, op4_decontamination, op5_line_dedup, op6_sharding, op7_rank_profiles, op8_minhash, op9_quality_rules, op10_mixing)}
SQL = {"op5_line_dedup": sql.LINES, "op8_minhash": sql.NEAR_DUPLICATES}
