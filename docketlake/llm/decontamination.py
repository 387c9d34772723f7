"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Texts and items are lower-cased runs of letters and digits. A window has as many words as the
item it may hold. Windows and items are fingerprinted over their 5-word shingles (items below
5 words are one shingle), repeats counted. The index cuts the 64 bits into BLOCKS blocks and
files each item under every value within RADIUS // BLOCKS bits of its own in each block: two
fingerprints within RADIUS differ by no more than that in at least one block, so all of them
are found. Candidates within RADIUS are verified by their exact weighted Jaccard similarity,
shingles weighing as often as they occur: sum of minima / sum of maxima >= SIMILARITY.

A window can only be that similar if nearly all its shingles (8 in 9 at SIMILARITY 0.8) are
shingles of items of its size; windows below that count are not fingerprinted, which loses
nothing. The shingles of the items travel to the tasks in blocks of ITEM_BLOCK items, one scan
of the documents each, so their size is bounded whatever the benchmark has.

Null and empty texts and items hold nothing and match nothing. Items of equal words are one
class, reported under its smallest item_id; null if none of them has an id, and then every class
is an item of its own. Repeated documents are reported row by row.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import stage

WIDTH, SIMILARITY, RADIUS, BLOCKS, ITEM_BLOCK = 5, 0.8, 23, 6, 20_000
#: Index rows (five numbers each) that may be broadcast.
INDEX_ROWS = 400_000
BITS = [11, 11, 11, 11, 10, 10]
STARTS = [sum(BITS[:b]) for b in range(BLOCKS)]
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(found: list[str]) -> np.ndarray:
    k = min(WIDTH, len(found))
    return np.array([xxhash.xxh64_intdigest(" ".join(found[i:i + k]), 0) for i in range(len(found) - k + 1)] if k else [], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


class Prefilter:
    """Finds the windows of a text whose shingles nearly all belong to items of the window's size."""

    def __init__(self, items: list[list[str]]):
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for item in items for w in item}))}
        self.sizes: dict[int, dict[tuple, set[int]]] = {}
        for item in items:
            k = min(WIDTH, len(item))
            known = [self.ids[w] for w in item]
            for i in range(len(item) - k + 1):
                self.sizes.setdefault(k, {}).setdefault(tuple(known[i:i + k]), set()).add(len(item))
        self.keys = {k: np.unique(self._mix(np.array(list(of), np.uint64))) for k, of in self.sizes.items()}

    @staticmethod
    def _mix(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            out = (out + column) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def windows(self, found: list[str]) -> list[tuple[int, int]]:
        """(start, size) of every window worth a fingerprint."""
        out = []
        known = np.fromiter((self.ids.get(w, 0) for w in found), np.uint64, len(found))
        for k, of in self.sizes.items():
            if len(found) < k:
                continue
            n = len(found) - k + 1
            whole = np.ones(n, bool)
            for j in range(k):
                whole &= known[j:n + j] > 0
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            mixed = self._mix(known[at[:, None] + np.arange(k)])
            place = np.minimum(np.searchsorted(self.keys[k], mixed), len(self.keys[k]) - 1)
            hits: dict[int, list[int]] = {}
            for p in at[self.keys[k][place] == mixed].tolist():
                for size in of.get(tuple(known[p:p + k].tolist()), ()):
                    hits.setdefault(size, []).append(p)
            for size, places in hits.items():
                shingles = size - k + 1
                need = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * shingles - 1e-9))
                seen = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n))])
                if n >= shingles:
                    enough = seen[shingles:] - seen[:n - shingles + 1] >= need
                    out += [(int(s), size) for s in np.flatnonzero(enough)]
        return out


def _windows(prefilter):
    def run(batches):
        index = prefilter.value
        for batch in batches:
            carried = [c for c in batch.schema.names if c != "__text"]
            rows, starts, sizes, fps, shingles = [], [], [], [], []
            for row, text in enumerate(batch.column("__text")):
                found = normal_words(text.as_py())
                for start, size in index.windows(found):
                    hashes = shingle_hashes(found[start:start + size])
                    rows.append(row)
                    starts.append(start)
                    sizes.append(size)
                    fps.append(simhash(hashes))
                    shingles.append(hashes.view(np.int64))
            taken = batch.select(carried).take(pa.array(rows, pa.int64()))
            arrays = [pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=[*carried, "start_word", "n_words", "fp", "shingles"])
    return run


def _items(batches):
    for batch in batches:
        found = [normal_words(t.as_py()) for t in batch.column("text")]
        hashes = [shingle_hashes(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array([" ".join(f) for f in found]), pa.array([len(f) for f in found], pa.int32()),
             pa.array([simhash(h) if len(h) else 0 for h in hashes], pa.int64()), pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))],
            names=["item_id", "words", "n_words", "fp", "shingles"])


def item_classes(bench: DataFrame) -> DataFrame:
    """One row per distinct item text that has words: item_id, item_copies, words, n_words, fp, shingles."""
    items = bench.select("item_id", "text").mapInArrow(_items, "item_id long, words string, n_words int, fp long, shingles array<long>")
    return items.filter("n_words > 0").groupBy("words").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("item_copies"), F.first("n_words").alias("n_words"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[b]).bitwiseAND(F.lit((1 << BITS[b]) - 1)).cast("int")


def _near(bits: int, radius: int) -> list[int]:
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(bits)}
    return sorted(masks)


def filed(items: DataFrame) -> DataFrame:
    """The index: each item under every near value of each of its blocks."""
    near = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("own"), F.array(*[F.lit(m) for m in _near(BITS[b], RADIUS // BLOCKS)]).alias("masks")) for b in range(BLOCKS)])
    each = items.select("*", F.inline(near).alias("block", "own", "masks"))
    return each.select("*", F.explode("masks").alias("mask")).withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "masks", "mask")


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as multisets of equal size."""
    of = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
    least = F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, x: s + F.least(of(a, x), of(b, x)))
    return least / (F.size(a) + F.size(b) - least)


def find_leaks(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows (keys, item_id, item_copies, start_word, n_words, distance, similarity): the best window per document and item."""
    spark = docs.sparkSession
    # Classes are numbered once, before they are staged: an item's id may be null.
    items = stage(item_classes(bench).withColumn("class", F.monotonically_increasing_id()), "bench-items")
    blocks = -(-items.count() // ITEM_BLOCK)
    held = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "__text")
    windows = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).select("words").collect()  # about ITEM_BLOCK short texts
        prefilter = spark.sparkContext.broadcast(Prefilter([r[0].split(" ") for r in some]))
        found = held.mapInArrow(_windows(prefilter), f"{schema}, start_word long, n_words int, fp long, shingles array<long>")
        windows = found if windows is None else windows.unionByName(found)
    if windows is None:
        windows = spark.createDataFrame([], f"{schema}, start_word long, n_words int, fp long, shingles array<long>")
    windows = stage(windows, "bench-windows")
    probes = windows.select("*", F.inline(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)])).alias("block", "value"))
    index = filed(items.select("class", "n_words", "fp"))
    # A few numbers per near value; beyond the bound the two sides are shuffled on the block values.
    small = items.count() * sum(len(_near(b, RADIUS // BLOCKS)) for b in BITS) <= INDEX_ROWS
    index = F.broadcast(index) if small else index.hint("merge")
    met = (probes["n_words"] == index["n_words"]) & (probes["block"] == index["block"]) & (probes["value"] == index["value"])
    distance = F.bit_count(probes["fp"].bitwiseXOR(index["fp"]))
    close = probes.join(index, met & (distance <= RADIUS)).select(
        *[probes[k] for k in keys], index["class"].alias("class_of"), probes["start_word"], distance.alias("distance"), probes["shingles"].alias("own"))
    found = close.join(items, close["class_of"] == items["class"]).withColumn("similarity", weighted_jaccard(F.col("own"), F.col("shingles")))
    best = F.max(F.struct(F.col("similarity"), (-F.col("distance")).alias("near"), (-F.col("start_word")).alias("early"), "n_words", "item_copies")).alias("w")
    return found.filter(F.col("similarity") >= SIMILARITY - 1e-12).groupBy(*keys, "item_id", F.when(F.col("item_id").isNull(), F.col("class")).alias("class_of")).agg(best).select(
        *keys, "item_id", "w.item_copies", (-F.col("w.early")).alias("start_word"), "w.n_words", (-F.col("w.near")).alias("distance"), F.round("w.similarity", 6).alias("similarity"))


def op10_benchmark_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


def drop_leaks(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a benchmark item go; equal texts go together."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    of = [F.xxhash64(at["text"]).alias("h"), F.length(at["text"]).alias("l")]
    found = find_leaks(held.select(*of, F.col(at["text"]).alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["h", "l"])
    leaks = stage(found.select(F.col("h").alias("h_of"), F.col("l").alias("l_of")).distinct(), "leaks")
    rows = held.select(*names, *of)
    kept = rows.join(leaks, (F.col("h") == F.col("h_of")) & (F.col("l") == F.col("l_of")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
