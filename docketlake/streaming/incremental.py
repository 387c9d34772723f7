"""Streams: first-seen texts and idempotent point loads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from docketlake.functions.identity import text_hash
from docketlake.operators.points import upsert

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfText(StatefulProcessor):
    """Keeps of each text hash whether it was seen; hands on the first row of a new one."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        first = None
        for some in rows:
            some = some if first is None else pd.concat([first, some])
            first = some.sort_values(self.order, kind="stable").iloc[:1]
        self.seen.update((True,))
        yield first

    def close(self) -> None:
        pass


def _keyed_state(spark: SparkSession) -> None:
    """State of any size lies in RocksDB on the executors' disks and, changes first, in the checkpoint."""
    spark.conf.set(_STATE_STORE, ROCKS_DB)


def start_new_texts(stream: DataFrame, out: str, checkpoint: str, order: str, text: str = "text", **trigger: Any) -> StreamingQuery:
    """Appends the rows whose text was never seen before, across batches and restarts.

    Seen texts are keyed state: a batch looks up its own hashes and reads nothing of what came
    before, so its cost does not grow with history. State and output commit together with the
    batch; one that is repeated after a lost executor or a restart is written once. Blank
    texts are left out. Of equal texts in one batch the first by ``order`` counts.
    """
    _keyed_state(stream.sparkSession)
    hashed = stream.withColumn("text_hash", text_hash(F.col(text))).filter(F.col("text_hash").isNotNull())
    firsts = hashed.groupBy("text_hash").transformWithStateInPandas(FirstOfText(order), hashed.schema, "Append", "None")
    writer = firsts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)


def start_upserts(points: DataFrame, path: str, checkpoint: str, version: str, **trigger: Any) -> StreamingQuery:
    """Loads points by id; loading a batch twice leaves the collection as it is."""

    def load(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, batch, path, version)

    writer = points.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
