"""Dense, sparse and hybrid search for a table of queries.

Queries are taken QUERY_BLOCK at a time; each block is one scan of the points. A task multiplies
its vectors with the block's query matrix, keeps the best ``limit`` rows per query and sends
no more than those: a bounded heap per query and split. Spark merges the heaps by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from docketlake.operators.search import LEG_LIMIT, RRF_K

#: Queries and query terms of one scan, vectors multiplied at once, and candidates kept before they are cut.
QUERY_BLOCK, TERM_BLOCK, ROWS, PENDING = 512, 1 << 14, 1024, 200_000


class _Heaps:
    """The best rows per query seen so far; equal scores go to the smaller key."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.kth = limit, np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores (rows x queries); NaN is no score."""
        row, query = np.nonzero(scores >= self.kth)
        self.parts.append((query, scores[row, query], keys[row]))
        self.held += len(row)
        if self.held > PENDING:
            self.cut()

    def cut(self) -> tuple:
        query, score, key = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.limit
        full = query[place == self.limit - 1]
        self.kth[full] = score[place == self.limit - 1]
        self.parts, self.held = [(query[keep], score[keep], key[keep])], int(keep.sum())
        return self.parts[0]


def _keys(column: pa.Array) -> np.ndarray:
    """Keys that sort in numpy as in Spark."""
    return np.array(column.to_pylist(), np.str_) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _top(points: DataFrame, key: str, vector: str, n: int, limit: int, scores: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(query number, key, score): per split the best rows of ``n`` queries; ``scores`` yields row numbers and their scores."""
    held = points.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("key IS NOT NULL AND vector IS NOT NULL")
    schema = StructType([StructField("query", IntegerType()), held.schema["key"], StructField("score", DoubleType())])

    def run(batches):
        heaps, kind = _Heaps(n, limit), None
        for batch in batches:
            keys, kind = _keys(batch.column("key")), batch.schema.field("key").type
            for rows, found in scores(batch.column("vector")):
                heaps.add(found, keys[rows])
        if kind is not None:
            query, score, found = heaps.cut()
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(found.tolist(), kind), pa.array(score)], names=["query", "key", "score"])

    return held.mapInArrow(run, schema)


def _dense_scores(queries: list[list[float]]) -> Callable:
    # Vectors of one length share a matrix; a query without a vector, or of another length than the point's, has no score.
    wide = max(map(len, filter(None, queries)), default=0)
    matrix, used = np.zeros((wide, len(queries))), np.array([bool(q) and len(q) == wide for q in queries])
    for i in np.flatnonzero(used):
        q = np.asarray(queries[i], np.float64)
        matrix[:, i] = q / (np.linalg.norm(q) or 1.0)

    def scores(vectors: pa.Array):
        fit = np.flatnonzero(pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == wide)
        for at in range(0, len(fit) if wide else 0, ROWS):
            rows = fit[at:at + ROWS]
            block = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)
            norms = np.linalg.norm(block, axis=1)
            # Products of equal vectors may differ in their last bits; rounded, they tie.
            found = np.round(block @ matrix / np.where(norms == 0, 1.0, norms)[:, None], 12)
            found[:, ~used] = np.nan
            yield rows, found

    return scores


def _sparse_scores(queries: list[dict[int, float]]) -> Callable:
    terms = np.array(sorted({t for q in queries for t in q}), np.int64)
    matrix = np.zeros((len(terms), len(queries)))
    for i, q in enumerate(queries):
        matrix[np.searchsorted(terms, sorted(q)), i] = [q[t] for t in sorted(q)]

    def scores(vectors: pa.Array):
        indices, values = vectors.field("indices"), vectors.field("values")
        step = max(16, min(ROWS, (1 << 22) // max(len(terms), 1)))
        for at in range(0, len(vectors) if len(terms) else 0, step):
            some = indices.slice(at, step)
            flat = some.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
            hit = terms[place] == flat
            block = np.zeros((len(some), len(terms)))
            block[row[hit], place[hit]] = values.slice(at, step).flatten().to_numpy(zero_copy_only=False)[hit]
            found = block @ matrix
            found[found <= 0] = np.nan  # no shared term
            yield np.arange(at, at + len(some)), found

    return scores


def _blocks(queries: DataFrame, query_key: str, vector: str) -> Iterator[tuple[list, list]]:
    """(ids, vectors) of QUERY_BLOCK queries at a time, fewer if they have many terms; the driver holds one block."""
    ids, vectors, terms = [], [], 0
    for r in queries.select(query_key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        more = 0 if isinstance(r[1], list) else len(r[1]["indices"])
        if ids and (len(ids) == QUERY_BLOCK or terms + more > TERM_BLOCK):
            yield ids, vectors
            ids, vectors, terms = [], [], 0
        ids.append(r[0]), vectors.append(r[1])
        terms += more
    if ids:
        yield ids, vectors


def _ranked(parts: list[DataFrame], query_key: str, limit: int) -> DataFrame:
    place = Window.partitionBy(query_key).orderBy(F.desc("score"), "key")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def _search(points: DataFrame, queries: DataFrame, query_key: str, key: str, vector: str, limit: int, scores: Callable) -> DataFrame:
    spark = points.sparkSession
    parts = [spark.createDataFrame([], StructType([queries.schema[query_key], StructField("key", points.schema[key].dataType), StructField("score", DoubleType())]))]
    for ids, vectors in _blocks(queries, query_key, vector):
        top = _top(points, key, vector, len(ids), limit, scores(vectors))
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("query", IntegerType()), queries.schema[query_key]]))
        parts.append(top.join(F.broadcast(names), "query").select(query_key, "key", "score"))  # at most QUERY_BLOCK names
    return _ranked(parts, query_key, limit).withColumnRenamed("key", key)


def dense_batch(points: DataFrame, queries: DataFrame, query_key: str, limit: int = 10, key: str = "point_uuid", vector: str = "dense") -> DataFrame:
    """(query_key, key, score, rank): best points per query by cosine. Column ``vector`` names both sides' vectors."""
    return _search(points, queries, query_key, key, vector, limit, _dense_scores)


def sparse_batch(points: DataFrame, queries: DataFrame, query_key: str, limit: int = 10, key: str = "point_uuid", vector: str = "sparse") -> DataFrame:
    """As dense_batch, by shared-term product; rows that share no term are no hits."""
    return _search(points, queries, query_key, key, vector, limit, lambda found: _sparse_scores([dict(zip(v["indices"], v["values"])) for v in found]))


def hybrid_batch(
    points: DataFrame, queries: DataFrame, query_key: str, limit: int = 10, key: str = "point_uuid",
    dense: str = "dense", sparse: str = "sparse", leg_limit: int | None = None, rrf_k: int = RRF_K,
) -> DataFrame:
    """(query_key, key, score, rank): both legs fused by rank per query; a query without one vector has one leg.

    Filters act on ``points`` before the call, hence inside both legs.
    """
    leg = leg_limit or max(limit, LEG_LIMIT)
    legs = [dense_batch(points, queries, query_key, leg, key, dense), sparse_batch(points, queries, query_key, leg, key, sparse)]
    parts = legs[0].unionByName(legs[1]).select(query_key, key, (1.0 / (rrf_k + F.col("rank"))).alias("part"))
    fused = parts.groupBy(query_key, key).agg(F.sum("part").alias("score"))
    return _ranked([fused.withColumnRenamed(key, "key")], query_key, limit).withColumnRenamed("key", key)
