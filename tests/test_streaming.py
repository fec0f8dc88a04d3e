"""Streams over the events table against batch counts."""

from pyspark.sql import functions as F

from sylva.operators.diversity import faiths_pd
from sylva.operators.phylo import forest
from sylva.sources.newick import parse_newick
from sylva.streaming import community as S

SF = "/root/testdata/sf0.001"


def test_sessions_cover_all_events(spark, tmp_path):
    got = S.run_to_table(S.sessions(S.file_stream(spark, SF), "user_id", "event_type"), "sessions_test", f"{tmp_path}/a")
    assert got.agg(F.sum("abundance")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_running_totals(spark, tmp_path):
    got = {r.key: r.total for r in S.run_to_table(S.running_totals(S.file_stream(spark, SF), "event_type"), "totals_test", f"{tmp_path}/b", "update").collect()}
    assert got == {r.event_type: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()}


def test_diversity_of_closed_windows(spark, tmp_path):
    types = sorted(r.event_type for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect())
    nodes = forest(spark, {"types": parse_newick("(" + ",".join(f"{t}:1" for t in types) + ");")})
    counts = S.windowed(S.file_stream(spark, SF), "event_type")
    S.diversity_stream(counts, nodes, f"{tmp_path}/sink", f"{tmp_path}/c").awaitTermination()
    got = {r["sample"]: r["pd"] for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm").alias("sample"), F.col("event_type").alias("taxon")).agg(F.count("*").cast("double").alias("abundance"))
    want = {r["sample"]: r["pd"] for r in faiths_pd(nodes, batch).collect()}
    assert got and all(want[k] == v for k, v in got.items())
