"""Tables that are computed once and read back from the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; local sessions without one get a folder of their own, others fail."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docketlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it may be deleted when the application has ended."""
    return f"{shared_folder(spark)}/docketlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, label: str) -> DataFrame:
    """The rows, written and read back: computed once, however often they are used."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
