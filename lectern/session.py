"""The session used by tests and benchmarks; a cluster brings its own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(name: str = "lectern", cpus: str | int | None = None) -> SparkSession:
    """A local session with adaptive execution and UTC time."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which the driver and all executors share; a local session without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="lectern-")
        atexit.register(folder.cleanup)
        at = f"file://{folder.name}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"
