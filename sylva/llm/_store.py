"""The folder that driver and executors share, and small tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one where a local session names none."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} names no folder that driver and executors share")
        base = getattr(spark, "_sylva_shared", None)
        if base is None:
            base = spark._sylva_shared = "file://" + tempfile.mkdtemp(prefix="sylva-")
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for one run of an operator."""
    return f"{shared_dir(spark)}/sylva-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage is cut and no executor's loss can undo it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)
