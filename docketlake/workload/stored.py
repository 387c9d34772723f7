"""Search and updates on stored tables: postings, two-pass vectors, a table of queries, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.operators import batch_search, postings, quantized
from docketlake.operators import search as S
from docketlake.operators.collection import Collection
from docketlake.staging import scratch, staged
from docketlake.workload.search import LANGS, QUERY, _cos, _sparse_sql, _terms_sql, documents, example_vector, points
from docketlake.workload.search import ORACLES as SEARCH_SQL


def sparse_indexed(spark, sf_dir):
    """Top documents among some languages from stored postings; the texts are read once, to build them."""
    path = scratch(spark, "postings")
    postings.build(S.with_sparse(documents(spark, sf_dir, "doc_id", "text", "lang")), path, "doc_id", carried=["lang"])
    return postings.search(spark, path, QUERY, 10, "doc_id", lambda rows: S.build_filter(rows, lang=LANGS))


def dense_two_pass(spark, sf_dir):
    path = scratch(spark, "vectors")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    quantized.build(vectors, path, "vec_id", "embedding", ["label"])
    found = quantized.search(spark, path, example_vector(spark, sf_dir), 10, "vec_id", "embedding")
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


def hybrid_batch(spark, sf_dir):
    """All benchmark texts as queries, with the embedding of the same number where there is one: 10 fused hits each."""
    queries = S.with_sparse(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("dense"))
    queries = staged(queries.join(vectors, "item_id", "left").select("item_id", "sparse", "dense"), "queries")
    stored = staged(points(spark, sf_dir), "points")
    found = batch_search.hybrid_batch(stored, queries, "item_id", 10, "doc_id")
    return found.select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def _judgment_points(spark, sf_dir, version, where):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(where)
    return orders.select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("point_uuid"), F.concat(F.lit("case "), F.col("o_custkey").cast("string")).alias("case_number"),
        F.col("o_orderpriority").alias("court_level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_judgment"),
        F.lit(version).cast("int").alias("version"), F.concat_ws("/", F.lit(version).cast("string"), "o_orderstatus").alias("payload"))


def _stored_versions(spark, sf_dir) -> Collection:
    """Four loads: most orders, the same once more, newer versions of some with new ones, older versions of all."""
    stored = Collection(spark, scratch(spark, "collection"))
    for version, where in ((2, "o_orderkey % 7 > 0"), (2, "o_orderkey % 7 > 0"), (3, "o_orderkey % 7 < 2"), (1, "true")):
        stored.upsert(_judgment_points(spark, sf_dir, version, where), "version")
    return stored


def upsert_versions(spark, sf_dir):
    return _stored_versions(spark, sf_dir).read().select("point_uuid", "version", "payload")


def collection_filtered(spark, sf_dir):
    """Points of the merged collection that pass filters on a rare and on a frequent field."""
    stored = _stored_versions(spark, sf_dir).read()
    where = S.build_filter(stored, case_number=["case 1", "case 4", "case 7", "case 10"]) | S.build_filter(stored, court_level="1-URGENT", date_judgment="1995-03-05", point_type=None)
    return stored.filter(where).select("point_uuid", "case_number", "court_level", "date_judgment", "version")


QUERIES = {
    "sparse_indexed": sparse_indexed,
    "dense_two_pass": dense_two_pass,
    "hybrid_batch": hybrid_batch,
    "upsert_versions": upsert_versions,
    "collection_filtered": collection_filtered,
}

_VERSIONS_SQL = """SELECT 'p' || o_orderkey AS point_uuid, 'case ' || o_custkey AS case_number, o_orderpriority AS court_level, strftime(o_orderdate, '%Y-%m-%d') AS date_judgment,
    v AS version, v || '/' || o_orderstatus AS payload FROM (SELECT *, CASE WHEN o_orderkey % 7 < 2 THEN 3 ELSE 2 END AS v FROM orders)"""

ORACLES = {
    "sparse_indexed": _sparse_sql("(SELECT * FROM documents WHERE lang IN ('en', 'de'))", 10),
    "dense_two_pass": SEARCH_SQL["dense_topk"],
    "hybrid_batch": f"""WITH asked AS (SELECT b.item_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
      dense AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 12) DESC, doc_id) AS r
        FROM (SELECT a.item_id, d.doc_id, {_cos('e.embedding').replace("(SELECT embedding FROM embeddings WHERE vec_id = 0)", "a.embedding")} AS s
          FROM asked a, documents d JOIN embeddings e ON e.vec_id = d.doc_id)),
      sparse AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r
        FROM (SELECT q.item_id, d.doc_id, sum(d.tf * q.tf) AS s FROM ({_terms_sql('documents', 'doc_id')}) d JOIN ({_terms_sql('benchmark', 'item_id')}) q USING (idx) GROUP BY ALL)),
      fused AS (SELECT item_id, doc_id, sum((1.0 / (60 + r))::DOUBLE) AS s FROM (SELECT * FROM dense WHERE r <= 20 UNION ALL SELECT * FROM sparse WHERE r <= 20) GROUP BY ALL)
      SELECT item_id, doc_id, rank, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM fused) WHERE rank <= 10""",
    "upsert_versions": f"SELECT point_uuid, version, payload FROM ({_VERSIONS_SQL})",
    "collection_filtered": f"""SELECT point_uuid, case_number, court_level, date_judgment, version FROM ({_VERSIONS_SQL})
      WHERE case_number IN ('case 1', 'case 4', 'case 7', 'case 10') OR (court_level = '1-URGENT' AND date_judgment = '1995-03-05')""",
}
