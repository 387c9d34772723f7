"""What the operators share: words, bindings inside a row, and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows that may be broadcast or collected: small keyed tables of a few numbers each.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Words (runs of anything but ASCII blanks) of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one made here for local sessions."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-stage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(frame: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, lineage cut.

    Lost executors cost nothing that is staged. Staged tables lie below
    ``<shared folder>/llm/<application id>`` and may be deleted when the application ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def with_small(frame: DataFrame, small: DataFrame, rows: int, keys: list[str], spread: int = 32) -> DataFrame:
    """Left join to a table of one row per key, null keys matching null.

    Up to BROADCAST_ROWS rows it is broadcast; a larger one is joined on salted keys, so that
    a key with a third of all rows is dealt over ``spread`` tasks. ``rows``: its counted rows.
    """
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [frame[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    if rows <= BROADCAST_ROWS:
        return frame.join(F.broadcast(right), on, "left").drop(*drop)
    salted = frame.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int"))
    right = right.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    on = [salted[k].eqNullSafe(F.col(f"__{k}")) for k in keys] + [salted["__salt"] == F.col("__salt_of")]
    return salted.join(right, on, "left").drop(*drop, "__salt", "__salt_of")
