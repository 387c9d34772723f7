"""Near-duplicates by 64-bit SimHash with a positional byte index and count filtering.

Fingerprints within RADIUS bits differ in at most RADIUS of their 8 bytes, so such a pair
shares at least 5 bytes at equal positions. Postings of single bytes would hold 1/256 of the
corpus each; here a posting is keyed by 4 positional bytes at once. The 14 quadruples of
positions whose numbers XOR to zero leave out every 3 positions in at least one of them, so
each pair that can qualify meets in some posting. Where it meets, its shared positional bytes
are tallied, pairs below the guaranteed 5 are discarded and the rest verified by their bits,
all inside the join, so that no unverified pair is ever a row.

Postings beyond HEAVY members are split by one more byte: of the 4 bytes left, a qualifying
pair shares at least one, so the four finer postings together lose nothing.

Copies have one fingerprint and are one node; links are found between different fingerprints
only. Texts: A-Z lower-cased, words are runs of non-blanks, 3-word shingles with repeats.
Null, empty and blank texts have fingerprint zero, which links like any other. Null ids are
allowed (a component's id is its smallest known id). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import stage
from docketlake.llm.graph import components

RADIUS, SHARED, HEAVY, WIDTH = 3, 5, 64, 3
QUADRUPLES = [(a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if (a ^ b ^ c) > c]


def fingerprint(text: str | None) -> int:
    """SimHash of a text as a signed 64-bit number; any length, in blocks of shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(len(found) - WIDTH + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        some = [b" ".join(found[i:i + WIDTH]) for i in range(at, min(n, at + (1 << 15)))]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in some), np.uint64, len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        fps = pa.array([fingerprint(t.as_py()) for t in batch.column("__text")], pa.int64())
        rest = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [fps], names=[*rest, "fp"])


def fingerprints(docs: DataFrame, text: str = "text", *carried: str) -> DataFrame:
    """The ``carried`` columns and ``fp``."""
    held = docs.select(*carried, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "__text")
    return held.mapInArrow(_fingerprints, f"{schema}, fp long" if schema else "fp long")


def _mask(positions) -> int:
    bits = sum(255 << (8 * p) for p in positions)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _masked(fp: Column, keys: list[tuple[int, int]]) -> Column:
    """The (key number, kept bytes) postings of a fingerprint."""
    return F.array(*[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m)).alias("v")) for k, m in keys])


def links(fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of different fingerprints within RADIUS bits, each found once or more."""
    postings = fps.select(F.col("fp"), F.inline(_masked(F.col("fp"), [(k, _mask(q)) for k, q in enumerate(QUADRUPLES)])).alias("k", "v"))
    heavy = stage(postings.groupBy("k", "v").count().filter(F.col("count") > HEAVY).select("k", "v"), "heavy-postings")
    finer = [F.struct(F.lit(100 + 8 * k + p).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask((*q, p)))).alias("v"), F.lit(k).alias("of"))
             for k, q in enumerate(QUADRUPLES) for p in range(8) if p not in q]
    split = postings.join(heavy, ["k", "v"], "left_semi")
    split = split.select("fp", F.inline(F.filter(F.array(*finer), lambda s: s["of"] == F.col("k"))).alias("k", "v", "of")).drop("of")
    light = postings.join(heavy, ["k", "v"], "left_anti").select("fp", "k", "v")
    index = light.unionByName(split)
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum(F.shiftright(differ, 8 * p).bitwiseAND(F.lit(255)).eqNullSafe(F.lit(0)).cast("int") for p in range(8))
    met = (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, met & (tally >= SHARED) & (F.bit_count(differ) <= RADIUS)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def grouped(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds root (a fingerprint per component) and component_id to staged rows with ``key`` and ``fp``.

    Copies meet in combined minima per fingerprint, never as rows of one task.
    """
    per = stage(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("copies")), "fingerprints")
    roots = components(links(per.select("fp")))
    met = stage(per.join(roots, per["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "rooted")
    ids = met.filter("linked").groupBy("root").agg(F.min("first").alias("id"))
    linked = met.filter("linked").join(ids, "root").select(F.col("fp").alias("fp_of"), "root", F.col("id").alias("component"))
    copies = met.filter("NOT linked AND copies > 1").select(F.col("fp").alias("fp_of"), "root", F.col("first").alias("component"))
    classes = linked.unionByName(copies)
    out = prints.join(classes, prints["fp"] == classes["fp_of"], "left").drop("fp_of")
    # A fingerprint of its own is in no class: its only document is its component.
    return out.withColumn("component_id", F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("component"))) \
        .withColumn("root", F.coalesce("root", "fp")).drop("component")


def op4_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = stage(fingerprints(docs, "text", "doc_id"), "simhash")
    return grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark, docs, sf_dir):
    """Pipeline stage: of each group the document with the smallest id (then fingerprint) stays, once.

    Ids, fingerprints and text hashes are staged, texts are not: they pass one shuffle, to
    meet the documents that stay. Rows that repeat an id and a text are ranked where it put them.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    held = held.select(*names, doc_id.isNull().alias("unknown"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"))
    same = ["unknown", "id", "h"]
    prints = stage(fingerprints(held, at["text"], at["doc_id"], *same).withColumnRenamed(at["doc_id"], "doc_id"), "simhash-docs")
    stays = grouped(prints).groupBy("root").agg(F.min(F.struct("unknown", "id", "fp", "h")).alias("s"))
    kept = held.join(stays.select(*[F.col(f"s.{c}").alias(c) for c in same]), same)
    first = F.row_number().over(Window.partitionBy(*same).orderBy("h"))
    return kept.withColumn("place", first).filter("place = 1").select(*[F.col(n).alias(c) for c, n in at.items()])
