"""Session defaults for local runs and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "strandline", cpus: int | None = None) -> SparkSession:
    """A session on this machine; a cluster brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
