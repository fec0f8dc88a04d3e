"""The community table as a stream: samples are windows of time or sessions, taxa are a column's values.

Counts are kept by (window, taxon) with a watermark, so state is bounded by the lateness allowed;
diversity is computed on the counts of each micro-batch's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diversity import faiths_pd


def file_stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A table's Parquet files as a stream with event time ``at``."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, taxon: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(sample, taxon, abundance) over tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return stream.withWatermark("at", late).groupBy(w.alias("w"), F.col(taxon).alias("taxon")).agg(F.count("*").alias("abundance")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("sample"), "taxon", F.col("abundance").cast("double").alias("abundance"))


def sessions(stream: DataFrame, who: str, taxon: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(sample, taxon, abundance) over each one's sessions of activity."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), F.col(who).alias("who"), F.col(taxon).alias("taxon")).agg(F.count("*").alias("abundance")).select(F.concat_ws("|", F.col("who").cast("string"), F.date_format("w.start", "yyyy-MM-dd HH:mm")).alias("sample"), "taxon", F.col("abundance").cast("double").alias("abundance"))


def running_totals(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """(key, total) kept in state of our own: one row for each key and micro-batch in which it occurs."""

    def update(who: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = (state.get[0] if state.exists else 0) + sum(len(p) for p in pdfs)
        state.update((total,))
        yield pd.DataFrame({"key": [str(who[0])], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(update, "key string, total long", "total long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over all there is and return the result as a table in memory."""
    query = counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)


def diversity_stream(counts: DataFrame, nodes: DataFrame, sink: str, checkpoint: str):
    """Faith's PD of the windows that each micro-batch closes, appended to a Parquet sink; a batch that runs
    again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        faiths_pd(nodes, batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return counts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
