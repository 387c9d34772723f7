"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table, narrowed to ``columns``, with at least one split per core.

    Row work here is heavy (dozens of regular expressions per text). A file that
    yields fewer splits than there are cores is dealt out once; large inputs have
    splits enough and are read as they lie, without a shuffle.
    """
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        frame = frame.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
