"""Search over documents (text) and embeddings (vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions.vectors import quantize
from docketlake.operators import search as S
from docketlake.workload.tables import table

QUERY = "the one with others and section 302 of the pld 2019 order from the thing"
LANGS = ["en", "de"]
WORDS = r"""list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}'))"""
SECTIONS = r"regexp_extract_all(lower(text), 'section\s+\d+[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?')"
REPORTERS = r"regexp_extract_all(lower(text), '\b(?:pld|scmr|clc|pcrlj|ptd|plc|cld|ylr|mld)\s+\d{4}\b')"
IDX = "('0x' || substr(md5(t), 1, 8))::BIGINT"


def _terms_sql(source: str, key: str) -> str:
    """(key, idx, tf) rows."""
    return f"""SELECT {key}, {IDX} AS idx, count(*)::DOUBLE AS tf
      FROM (SELECT {key}, unnest({WORDS} || {SECTIONS} || {REPORTERS}) AS t FROM {source}) GROUP BY {key}, {IDX}"""


_QUERY_SQL = f"(SELECT 0 AS q, '{QUERY}' AS text)"


def _sparse_sql(source: str, limit: int) -> str:
    return f"""SELECT doc_id, score FROM (SELECT d.doc_id, sum(d.tf * q.tf) AS score
      FROM ({_terms_sql(source, 'doc_id')}) d JOIN ({_terms_sql(_QUERY_SQL, 'q')}) q USING (idx) GROUP BY d.doc_id)
      ORDER BY score DESC, doc_id LIMIT {limit}"""


def _cos(v: str) -> str:
    q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
    d = f"list_dot_product({v}::DOUBLE[], {q}::DOUBLE[])"
    n = f"sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])) * sqrt(list_dot_product({q}::DOUBLE[], {q}::DOUBLE[]))"
    return f"({d} / ({n}))"


def documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *columns)


def points(spark, sf_dir):
    """All documents with term vectors, and their embeddings where they have one."""
    docs = S.with_sparse(documents(spark, sf_dir, "doc_id", "text", "lang"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    return docs.join(vectors, "doc_id", "left").select("doc_id", "lang", "sparse", "dense")


def example_vector(spark, sf_dir) -> list[float]:
    """The query of the examples: the embedding with id 0."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return list(vectors.filter("vec_id = 0").select("embedding").first()[0])


def sparse_topk_filtered(spark, sf_dir):
    docs = S.with_sparse(documents(spark, sf_dir, "doc_id", "text", "lang").filter(F.col("lang").isin(LANGS)))
    return S.search_sparse(docs.select("doc_id", "sparse"), QUERY, 10, key="doc_id")


def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = S.search_dense(vectors, example_vector(spark, sf_dir), 10, key="vec_id", vector="embedding")
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


def dense_filtered_threshold(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    where = S.build_filter(vectors, label=[1, 2, 3], vec_id=None)
    found = S.search_dense(vectors, example_vector(spark, sf_dir), 25, where, 0.1, "vec_id", "embedding")
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


def hybrid_rrf(spark, sf_dir):
    found = S.search_hybrid(points(spark, sf_dir), QUERY, example_vector(spark, sf_dir), 10, key="doc_id")
    return S.format_results(found, "doc_id").select("id", "score")


def hybrid_filtered(spark, sf_dir):
    """Hybrid search among the texts of some languages, hits with their six display fields."""
    docs = points(spark, sf_dir).withColumns({
        "case_number": F.concat(F.lit("D "), F.col("doc_id").cast("string")), "case_title": F.concat_ws("/", "lang", "doc_id"),
        "court_level": F.col("lang"), "case_type": F.concat(F.lit("type "), (F.col("doc_id") % 5).cast("string")),
        "date_judgment": F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0")),
        "judgment_type": F.when(F.col("doc_id") % 3 > 0, "order")})
    where = S.build_filter(docs, court_level=LANGS)
    return S.format_results(S.search_hybrid(docs, QUERY, example_vector(spark, sf_dir), 30, where, key="doc_id"), "doc_id")


def term_frequency(spark, sf_dir):
    """Per document: distinct terms, all terms, and a digest of the term vector."""
    docs = S.with_sparse(documents(spark, sf_dir, "doc_id", "text"))
    indices, values = F.col("sparse.indices"), F.col("sparse.values")
    weighted = F.aggregate(
        F.arrays_zip(indices.alias("i"), values.alias("v")), F.lit(0).cast("bigint"),
        lambda s, p: s + p["i"] % 1000 * p["v"].cast("bigint"),
    )
    return docs.select(
        "doc_id",
        F.coalesce(F.size(indices), F.lit(0)).cast("bigint").alias("n_terms"),
        F.coalesce(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.lit(0.0)).alias("n_tokens"),
        F.coalesce(weighted, F.lit(0).cast("bigint")).alias("digest"),
    )


def corpus_vocabulary(spark, sf_dir):
    """Document and collection frequency per term index.

    Rows reach the shuffle as one partial count per term and split, however
    frequent the term is.
    """
    docs = S.with_sparse(documents(spark, sf_dir, "doc_id", "text"))
    rows = docs.select(F.inline(F.arrays_zip("sparse.indices", "sparse.values")).alias("idx", "tf"))
    return rows.groupBy("idx").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_tokens"))


def quantized_vectors(spark, sf_dir):
    """Largest error of the one-byte form per vector, in steps of its scale."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("q", quantize(F.col("embedding").cast("array<double>")))
    errors = F.zip_with(
        F.col("embedding").cast("array<double>"), F.col("q.values"),
        lambda x, b: F.abs(x - b * F.col("q.scale")),
    )
    return vectors.select(
        "vec_id",
        F.array_join(F.slice(F.col("q.values"), 1, 8), ",").alias("first_bytes"),
        (F.array_max(errors) <= F.col("q.scale") * 0.5000001).alias("within_half_step"),
    )


QUERIES = {
    "sparse_topk_filtered": sparse_topk_filtered,
    "dense_topk": dense_topk,
    "dense_filtered_threshold": dense_filtered_threshold,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_filtered": hybrid_filtered,
    "term_frequency": term_frequency,
    "corpus_vocabulary": corpus_vocabulary,
    "quantized_vectors": quantized_vectors,
}


def _hybrid_sql(where: str, leg: int, limit: int) -> str:
    """(doc_id, s): the fused best of both legs."""
    return f"""WITH pts AS (SELECT d.*, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE {where}),
      dense AS (SELECT doc_id, s AS score FROM (SELECT doc_id, {_cos('embedding')} AS s FROM pts WHERE embedding IS NOT NULL) ORDER BY s DESC, doc_id LIMIT {leg}),
      sparse AS ({_sparse_sql("pts", leg)}),
      ranked AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM dense
        UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM sparse)
      SELECT doc_id, sum(part::DOUBLE) AS s FROM ranked GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT {limit}"""


ORACLES = {
    "sparse_topk_filtered": _sparse_sql("(SELECT * FROM documents WHERE lang IN ('en', 'de'))", 10),
    "dense_topk": f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT *, {_cos('embedding')} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10",
    "dense_filtered_threshold": f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT *, {_cos('embedding')} AS s FROM embeddings WHERE label IN (1, 2, 3)) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 25",
    "hybrid_rrf": f"SELECT doc_id AS id, round(s, 4) AS score FROM ({_hybrid_sql('true', 20, 10)})",
    "hybrid_filtered": f"""SELECT doc_id AS id, round(s, 4) AS score, 'D ' || doc_id AS case_number, lang || '/' || doc_id AS case_title, lang AS court_level,
      'type ' || (doc_id % 5) AS case_type, '20' || lpad((doc_id % 24)::VARCHAR, 2, '0') AS date_judgment, CASE WHEN doc_id % 3 > 0 THEN 'order' END AS judgment_type
      FROM ({_hybrid_sql("lang IN ('en', 'de')", 30, 30)}) JOIN documents USING (doc_id)""",
    "term_frequency": f"""SELECT d.doc_id, coalesce(count(t.idx), 0) AS n_terms, coalesce(sum(t.tf), 0) AS n_tokens,
      coalesce(sum(t.idx % 1000 * t.tf::BIGINT), 0)::BIGINT AS digest
      FROM documents d LEFT JOIN ({_terms_sql('documents', 'doc_id')}) t USING (doc_id) GROUP BY d.doc_id""",
    "corpus_vocabulary": f"SELECT idx, count(*) AS n_docs, sum(tf) AS n_tokens FROM ({_terms_sql('documents', 'doc_id')}) GROUP BY idx",
    "quantized_vectors": """SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda x:
        round(x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) * 127)::TINYINT), ',') AS first_bytes,
      true AS within_half_step FROM embeddings""",
}
