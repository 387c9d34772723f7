"""Sessions: settings that hold from a laptop to a large cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime re-planning splits skewed join partitions and merges small ones; UTC makes
# dates independent of the machine.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Filters reach Python data sources.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def local_session(cores: str | int | None = None, **extra: str) -> SparkSession:
    """Session for tests and benches on one machine."""
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docketlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
