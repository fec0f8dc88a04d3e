"""A SparkSession with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "sylva", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it gives.

    Adaptive execution plans joins, partition counts and skew at run time; UTC keeps
    timestamps equal to those of other engines.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]", "spark.app.name": app, "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sylva-")
    return base.rstrip("/")
