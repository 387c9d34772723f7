"""What the trained text operators share: labels, bounded training samples and scores per batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts per class that a model is fitted on, at most. Scores cover all rows.
TRAIN_ROWS = 2500


def held_out(doc_id: Column) -> Column:
    """Rows kept away from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def calibrating(doc_id: Column) -> Column:
    """Labelled rows that are neither held out nor fitted on: a fifth, for choosing thresholds."""
    return ~held_out(doc_id) & (F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled texts per class, chosen by a hash of the id, never held out or calibrating."""
    usable = labels.select(F.col("doc_id").alias("id_of"), F.col(label).alias("__y")).filter(F.col("__y").isin(0, 1) & ~held_out(F.col("id_of")) & ~calibrating(F.col("id_of")))
    picked = [usable.filter(F.col("__y") == y).orderBy(F.xxhash64("id_of"), "id_of").limit(rows) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * rows numbers
    found = docs.join(ids, docs["doc_id"] == ids["id_of"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__y")
    return [(r["text"], int(r["__y"])) for r in found.orderBy("doc_id", "__y", F.xxhash64("text")).limit(4 * rows).collect()]


def scored(docs: DataFrame, model, keys: list[str], text: str = "text") -> DataFrame:
    """Adds ``score`` = model.scores(texts) to the keys; ``model`` travels once per executor."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            carried = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(m.scores(texts), pa.float64())], names=[*carried, "score"])

    held = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "__text")
    return held.mapInArrow(run, f"{schema}, score double")
