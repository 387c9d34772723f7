"""Sparse search over stored postings.

``build`` writes two tables. ``postings`` has a row per term and document, laid out by term:
folders by the leading bits of the term index, files and row groups in order of (idx, segment),
cut by range, so that a frequent term covers several files. ``blocks`` has a row per term and
segment with the largest tf in it. A segment is about SEGMENT documents of like length: weights
are raw term counts, so long documents score highest, and bounds of segments differ.

A search reads the rows of its own terms only (folder pruning, then row groups and pages by idx)
and tokenizes no document. The blocks bound every segment's score. The best PROBED segments
are scored first; segments whose bound is below the k-th score found cannot hold a hit and
are never read. What is left is scored, so the result equals a full scan, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.search import with_sparse
from docketlake.staging import staged

#: Bits of a term index that name its folder; documents of a segment; segments scored first.
FOLDER_BITS, SEGMENT, PROBED = 6, 4096, 8
#: Up to so many segments are named in the scan itself; more are joined.
NAMED = 1000


def _folder(idx: Column) -> Column:
    return F.shiftright(idx, 32 - FOLDER_BITS).cast("int")


def _segmented(docs: DataFrame, size: int) -> DataFrame:
    """Adds ``segment``: documents of one length class, dealt over as many segments as the class needs."""
    total = F.aggregate("__sparse.values", F.lit(0.0), lambda s, v: s + v)
    held = docs.withColumn("__class", F.floor(F.log2(total) * 2).cast("int"))
    counted = {r[0]: -(-r[1] // size) for r in held.groupBy("__class").count().collect()}  # a class per half power of two
    if not counted:
        return held.withColumn("segment", F.lit(0).cast("long")).drop("__class")
    parts = F.create_map(*[F.lit(x) for pair in counted.items() for x in pair])[F.col("__class")]
    place = F.pmod(F.xxhash64("__key"), parts.cast("long"))
    return held.withColumn("segment", F.col("__class").cast("long") * (1 << 40) + place).drop("__class")


def build(docs: DataFrame, path: str, key: str, sparse: str = "sparse", carried: Sequence[str] = (), segment: int = SEGMENT) -> None:
    """Writes the index of documents with a term vector; ``carried`` columns can be filtered by."""
    # The vectors are stored first: several steps read them, and they are costly to make.
    held = staged(docs.select(F.col(key).alias("__key"), F.col(sparse).alias("__sparse"), *carried), "term-vectors").filter("__sparse IS NOT NULL AND __key IS NOT NULL")
    rows = _segmented(held, segment).select("segment", "__key", *carried, F.inline(F.arrays_zip("__sparse.indices", "__sparse.values")).alias("idx", "tf"))
    rows = rows.withColumnRenamed("__key", key).withColumn("folder", _folder(F.col("idx")))
    order = ["folder", "idx", "segment"]
    _write(rows, f"{path}/postings", order)
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    _write(stored.groupBy(*order).agg(F.max("tf").alias("most")), f"{path}/blocks", order)


def _write(rows: DataFrame, path: str, order: list[str]) -> None:
    """The rows in order, and a folder without rows, so that an empty index has its columns."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").option("parquet.block.size", str(8 << 20)).parquet(path)
    rows.limit(0).drop("folder").write.parquet(f"{path}/folder=-1")


def query_terms(spark: SparkSession, query: str) -> dict[int, float]:
    """The query's term indices and counts."""
    found = with_sparse(spark.range(1).select(F.lit(query).alias("text"))).select("sparse").first()[0]
    return dict(zip(found["indices"], found["values"])) if found else {}


def _of_terms(spark: SparkSession, path: str, table: str, wanted: dict[int, float]) -> DataFrame:
    """The stored rows of some terms, and ``weight``, each term's count in the query."""
    rows = spark.read.parquet(f"{path}/{table}")
    folders = sorted({i >> (32 - FOLDER_BITS) for i in wanted})
    rows = rows.filter(F.col("folder").isin(folders) & F.col("idx").isin(sorted(wanted)))
    weights = F.create_map(*[F.lit(x) for pair in sorted(wanted.items()) for x in pair])
    return rows.withColumn("weight", weights[F.col("idx")])


def segment_bounds(spark: SparkSession, path: str, wanted: dict[int, float]) -> DataFrame:
    """(segment, bound): no document of the segment scores more."""
    return _of_terms(spark, path, "blocks", wanted).groupBy("segment").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def _scored(spark: SparkSession, path: str, wanted: dict, key: str, where: Callable[[DataFrame], Column] | None, chosen: list | DataFrame) -> DataFrame:
    rows = _of_terms(spark, path, "postings", wanted)
    if where is not None:
        rows = rows.filter(where(rows))
    rows = rows.filter(F.col("segment").isin(chosen)) if isinstance(chosen, list) else rows.join(chosen.select("segment"), "segment", "left_semi")
    return rows.groupBy(key).agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))


def _best(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def open_segments(spark: SparkSession, path: str, wanted: dict, key: str, limit: int, where: Callable[[DataFrame], Column] | None = None) -> tuple[list, DataFrame]:
    """(segments scored first, those of the others that can still hold one of the best ``limit``)."""
    bounds = segment_bounds(spark, path, wanted)
    first = [r["segment"] for r in bounds.orderBy(F.desc("bound"), "segment").limit(PROBED).collect()]
    found = _best(_scored(spark, path, wanted, key, where, first), key, limit).collect()
    rest = bounds.filter(~F.col("segment").isin(first))
    return first, rest.filter(F.col("bound") >= found[-1]["score"]) if len(found) == limit else rest


def search(spark: SparkSession, path: str, query: str, limit: int = 10, key: str = "point_uuid", where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(key, score) of the best documents by shared-term product; ties by key, none without terms.

    ``where`` makes a condition on the carried columns, e.g. ``lambda rows: build_filter(rows, lang="en")``.
    """
    wanted = query_terms(spark, query)
    if not wanted:
        return spark.read.parquet(f"{path}/postings").select(key, F.col("tf").alias("score")).limit(0)
    first, rest = open_segments(spark, path, wanted, key, limit, where)
    named = [r["segment"] for r in rest.select("segment").limit(NAMED + 1).collect()]
    chosen = first + named if len(named) <= NAMED else rest.select("segment").unionByName(spark.createDataFrame([(s,) for s in first], "segment long"))
    return _best(_scored(spark, path, wanted, key, where, chosen), key, limit)
