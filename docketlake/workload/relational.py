"""Duplicates, keyed unions, lookups, limits, counts and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import identity as I
from docketlake.operators import dedup as D
from docketlake.operators import reports as R
from docketlake.operators.extraction import TIER_A, extract_tier_a
from docketlake.operators.quality import validate
from docketlake.workload import duck as Q
from docketlake.workload import extraction as E
from docketlake.workload import judgments as J
from docketlake.workload.tables import table

HASH_SQL = rf"sha256(regexp_replace(lower({Q.strip('text')}), '\s+', ' ', 'g'))"
UUID_SQL = """(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


def _md5_sql(key: str) -> str:
    return f"md5(unhex('{I.URL_NAMESPACE}') || encode({key}))"


def read(spark, sf_dir, name, *columns):
    if name in ("documents", "pages", "conversations"):
        return table(spark, sf_dir, name, *columns)
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


# ── duplicates ──
def text_hash_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    keyed = docs.select("doc_id", I.text_hash(F.col("text")).alias("text_hash")).filter("text_hash is not null")
    return D.first_per_group(keyed, ["text_hash"], ["doc_id"])


def duplicate_groups(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    hashed = docs.select("doc_id", I.text_hash(F.col("text")).alias("text_hash"))
    groups = hashed.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return groups.filter("copies > 1")


def duplicate_flags(spark, sf_dir):
    """Which documents repeat a text of the English ones, or an urgent order's number."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    number = F.concat(F.lit("Crl. A. "), (F.col("doc_id") * 3).cast("string"), F.lit("/2001"))
    numbered = docs.withColumn("case_number", F.when(F.col("doc_id") % 7 != 0, number).otherwise(""))
    known_hashes = docs.filter("lang = 'en' and doc_id % 2 = 0").select(I.text_hash(F.col("text")).alias("text_hash"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    known_numbers = urgent.select(
        I.normal_case_number(F.concat(F.lit("CRL.A. "), F.col("o_orderkey").cast("string"), F.lit("_2001"))).alias("normal_number")
    )
    flagged = D.flag_duplicates(numbered, known_hashes, known_numbers)
    return flagged.select("doc_id", "exact_duplicate", "case_number_match")


def _listed(spark, sf_dir):
    """Pages as listing rows: every third without URL, hosts standing in for repeats."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    url = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("url", "^([a-z]+://[^/]+/[a-z]+)", 1))
    return pages.select("page_id", url.alias("pdf_url"))


_LISTED_SQL = "(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)', 1) END AS pdf_url FROM pages)"
_FIRSTS_SQL = f"SELECT page_id, pdf_url FROM {_LISTED_SQL} WHERE pdf_url <> '' QUALIFY row_number() OVER (PARTITION BY pdf_url ORDER BY page_id) = 1"


def url_first_wins(spark, sf_dir):
    return D.first_by_url(_listed(spark, sf_dir), "pdf_url", ["page_id"])


def url_required(spark, sf_dir):
    return D.first_by_url(_listed(spark, sf_dir), "pdf_url", ["page_id"], without_url="drop")


def priority_union(spark, sf_dir):
    """Finished orders per customer first, open ones only for other customers."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    firsts = {
        status: D.first_per_group(orders.filter(F.col("o_orderstatus") == status), ["o_custkey"], ["o_orderkey"])
        for status in ("F", "O")
    }
    return D.priority_union(firsts["F"], firsts["O"], "o_custkey")


def limit_per_group(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    by_year = orders.select("o_orderkey", F.when(F.year("o_orderdate") != 1999, F.year("o_orderdate")).alias("year"))
    return D.limit_per_group(by_year, "year", ["o_orderkey"], 5)


def limit_rows(spark, sf_dir):
    return D.limit_rows(read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 20, ["o_orderkey"])


def fill_missing(spark, sf_dir):
    """Listing rows without a link take it from the post they point to."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    rows = pages.select(
        "page_id",
        F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")).alias("post_url"),
        F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.col("url"), F.lit("/own.pdf"))).alias("pdf_url"),
    )
    posts = pages.filter("page_id % 5 <> 0").select(
        F.col("url").alias("post_url"), F.concat(F.col("url"), F.lit("/post.pdf")).alias("pdf_url")
    )
    return D.fill_missing(rows, posts, "post_url", "pdf_url")


def dimension_lookup(spark, sf_dir):
    """Judge names by id, from a fixed table, with a default."""
    from docketlake.sources.sites import SINDH_JUDGES

    orders = read(spark, sf_dir, "orders", "o_orderkey")
    judge_id = F.col("o_orderkey") % 500 + 840
    return orders.select(
        "o_orderkey", D.name_of(judge_id, SINDH_JUDGES, F.concat(F.lit("Judge "), judge_id.cast("string"))).alias("judge_name")
    )


def _dimension_sql() -> str:
    from docketlake.sources.sites import SINDH_JUDGES

    rows = ", ".join(f"({i}, {Q.lit(n)})" for i, n in SINDH_JUDGES.items())
    return f"""SELECT o_orderkey, coalesce(n, 'Judge ' || (o_orderkey % 500 + 840)) AS judge_name
      FROM orders LEFT JOIN (VALUES {rows}) j(i, n) ON i = o_orderkey % 500 + 840"""


# ── counts ──
def _run_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return docs.select(
        "doc_id", "lang", "source",
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 22 == 0, "timeout").alias("error"),
    )


def run_summary(spark, sf_dir):
    return R.run_summary(_run_rows(spark, sf_dir))


def count_by_priority(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderpriority")
    return R.count_by(orders.withColumn("category", F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH"))), "category")


def counts_by_each(spark, sf_dir):
    return R.counts_by_each(read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


def corpus_profile(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "lang", "text")
    return R.corpus_profile(docs.select("lang", F.length("text").cast("bigint").alias("chars")), "lang", "chars")


def vector_norms(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"), F.round(F.stddev(norm), 4).alias("sd_norm")
    )


def discard_report(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_type", "value", "user_id")
    return R.discard_report(events, "user_id", (F.col("event_type") != "error") & (F.col("value") > 5))


# ── identity ──
def _keys(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return orders.select(
        "o_orderkey", F.element_at(F.array(F.lit("SC"), F.lit("LHC"), F.lit("SHC")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("court"),
        F.concat(F.lit("Crl.A "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 50 == 0, ":x").otherwise("/2001")).alias("number"),
    )


def point_identity(spark, sf_dir):
    keyed = _keys(spark, sf_dir)
    court, number = F.col("court"), F.col("number")
    key = I.point_key(court, number, F.lit("chunk"), F.col("o_orderkey") % 7)
    return keyed.select(
        "o_orderkey", key.alias("point_key"), I.name_uuid(key).alias("point_uuid"),
        I.name_uuid(I.parent_key(court, number)).alias("parent_uuid"), I.key_error(court, number).alias("error"),
        I.normal_case_number(number).alias("normal_number"),
    )


_KEYS_SQL = """(SELECT o_orderkey, ['SC', 'LHC', 'SHC'][o_orderkey % 3 + 1] AS court,
  'Crl.A ' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN ':x' ELSE '/2001' END AS number FROM orders)"""


def safe_filenames(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", I.safe_filename(F.concat(F.col("url"), F.lit("/a%20b(c)"))).alias("name"),
                        I.safe_filename(F.regexp_replace("url", r"[?#].*$", "")).alias("plain"))


# ── quality ──
GATE_FIELDS = ("case_number", "court_name", "judge_names", "date_judgment", "ppc_sections", "precedents_cited",
               "court_level", "diyat_compromise", "fir_number", "victim_name")


def quality_report(spark, sf_dir):
    docs = J.judgments(spark, sf_dir)
    docs = docs.withColumn("text", F.when(F.col("judgment_id") % 10 == 0, F.substring("text", 1, 300)).otherwise(F.col("text")))
    out = extract_tier_a(docs, into="payload", fields=GATE_FIELDS)
    gated = validate(out, {f: TIER_A[f] for f in GATE_FIELDS})
    return gated.select("judgment_id", "report.passed", F.array_join("report.errors", "; ").alias("errors"),
                        F.array_join("report.warnings", "; ").alias("warnings"), F.col("report.field_coverage").alias("coverage"))


_VALUES = ["case_number", "court_name", "court_level", "fir_number", "victim_name"]
QUALITY_SQL = f"""WITH i AS ({E.IDENTITY_SQL}), c AS ({E.CITED_SQL}), p AS ({E.PEOPLE_SQL}), t AS (SELECT judgment_id, text FROM ({J.SQL})),
r AS (SELECT t.*, i.case_number, i.court_name, i.court_level, i.date_judgment, c.ppc_sections, c.precedents_cited, c.fir_number, p.judge_names, p.victim_name
  FROM t JOIN i USING (judgment_id) JOIN c USING (judgment_id) JOIN p USING (judgment_id)),
f AS (SELECT *, 4 + {' + '.join(f'({v} IS NOT NULL)::INT' for v in _VALUES)} + (date_judgment IS NOT NULL)::INT AS present,
  1 + {' + '.join(f"(coalesce({v}, '') <> '')::INT" for v in _VALUES + ['judge_names', 'ppc_sections', 'precedents_cited'])} + (date_judgment IS NOT NULL)::INT AS used FROM r)
SELECT judgment_id, judgment_id % 10 <> 0 AND coalesce(case_number, '') <> '' AND coalesce(court_name, '') <> '' AS passed,
  CASE WHEN judgment_id % 10 = 0 THEN 'Text too short (300 chars, minimum 500)' ELSE concat_ws('; ',
    CASE WHEN coalesce(case_number, '') = '' THEN 'Missing required field: case_number' END,
    CASE WHEN coalesce(court_name, '') = '' THEN 'Missing required field: court_name' END) END AS errors,
  CASE WHEN judgment_id % 10 = 0 THEN '' ELSE concat_ws('; ',
    CASE WHEN date_judgment IS NULL THEN 'Missing expected field: date_judgment' END,
    CASE WHEN judge_names = '' THEN 'Missing expected field: judge_names' END,
    CASE WHEN ppc_sections = '' THEN 'Missing expected field: ppc_sections' END,
    CASE WHEN precedents_cited = '' THEN 'Missing expected field: precedents_cited' END) END AS warnings,
  CASE WHEN judgment_id % 10 = 0 THEN 0.0 ELSE round(used * 100.0::DOUBLE / present, 1) END AS coverage FROM f"""


QUERIES = {
    "text_hash_dedup": text_hash_dedup,
    "duplicate_groups": duplicate_groups,
    "duplicate_flags": duplicate_flags,
    "url_first_wins": url_first_wins,
    "url_required": url_required,
    "priority_union": priority_union,
    "limit_per_group": limit_per_group,
    "limit_rows": limit_rows,
    "fill_missing": fill_missing,
    "dimension_lookup": dimension_lookup,
    "run_summary": run_summary,
    "count_by_priority": count_by_priority,
    "counts_by_each": counts_by_each,
    "corpus_profile": corpus_profile,
    "vector_norms": vector_norms,
    "discard_report": discard_report,
    "point_identity": point_identity,
    "safe_filenames": safe_filenames,
    "quality_report": quality_report,
}
ORACLES = {
    "text_hash_dedup": f"SELECT min(doc_id) AS doc_id, {HASH_SQL} AS text_hash FROM documents WHERE {Q.strip('text')} <> '' GROUP BY text_hash",
    "duplicate_groups": f"SELECT {HASH_SQL} AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text_hash HAVING count(*) > 1",
    "duplicate_flags": f"""SELECT doc_id, {HASH_SQL} IN (SELECT {HASH_SQL} FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) AS exact_duplicate,
      doc_id % 7 <> 0 AND doc_id * 3 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS case_number_match FROM documents""",
    "url_first_wins": f"SELECT * FROM ({_FIRSTS_SQL}) UNION ALL SELECT page_id, pdf_url FROM {_LISTED_SQL} WHERE pdf_url = ''",
    "url_required": _FIRSTS_SQL,
    "priority_union": """WITH f AS (SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus)
      SELECT * FROM f WHERE o_orderstatus = 'F' UNION ALL
      SELECT * FROM f WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM f WHERE o_orderstatus = 'F')""",
    "limit_per_group": """SELECT o_orderkey, y::INT AS year FROM (SELECT o_orderkey, nullif(year(o_orderdate), 1999) AS y FROM orders)
      QUALIFY row_number() OVER (PARTITION BY y ORDER BY o_orderkey) <= 5""",
    "limit_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20",
    "fill_missing": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS post_url,
      CASE WHEN page_id % 2 = 1 THEN url || '/own.pdf' WHEN page_id % 4 <> 0 AND page_id % 5 <> 0 THEN url || '/post.pdf' ELSE '' END AS pdf_url FROM pages""",
    "dimension_lookup": _dimension_sql(),
    "run_summary": """SELECT count(*) AS total, count(*) FILTER (doc_id % 11 <> 0 AND text <> '') AS with_text,
      count(*) FILTER (doc_id % 11 = 0 OR text = '') AS empty_text, count(*) FILTER (doc_id % 22 = 0) AS errors FROM documents""",
    "count_by_priority": "SELECT coalesce(nullif(o_orderpriority, '2-HIGH'), 'unknown') AS category, count(*) AS n FROM orders GROUP BY 1",
    "counts_by_each": """SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
      SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM orders""",
    "corpus_profile": """SELECT lang, count(*) AS n, count(*) FILTER (length(text) = 0) AS empty, round(avg(length(text)), 4) AS mean_chars,
      quantile_cont(length(text)::DOUBLE, 0.5) AS p50_chars, quantile_cont(length(text)::DOUBLE, 0.95) AS p95_chars,
      max(length(text)) AS max_chars FROM documents GROUP BY lang""",
    "vector_norms": """SELECT label, count(*) AS n, round(avg(v), 4) AS mean_norm, round(stddev(v), 4) AS sd_norm FROM
      (SELECT label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings) GROUP BY label""",
    "discard_report": """SELECT user_id, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS discarded,
      CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed' WHEN count(*) FILTER (NOT ok) > count(*) * 0.5 THEN 'warning' ELSE 'ok' END AS status
      FROM (SELECT user_id, event_type <> 'error' AND value > 5 AS ok FROM events) GROUP BY user_id""",
    "point_identity": f"""WITH k AS (SELECT o_orderkey, court, number, court || ':' || number || ':chunk:' || (o_orderkey % 7) AS point_key FROM {_KEYS_SQL}),
      a AS (SELECT *, {_md5_sql('point_key')} AS h FROM k), b AS (SELECT *, {UUID_SQL} AS point_uuid FROM a),
      c AS (SELECT * EXCLUDE (h), {_md5_sql("(court || ':' || number)")} AS h FROM b)
      SELECT o_orderkey, point_key, point_uuid, {UUID_SQL} AS parent_uuid,
        CASE WHEN contains(number, ':') THEN 'key parts must be present and free of '':''' END AS error,
        upper(regexp_replace(number, '[^A-Za-z0-9]', '', 'g')) AS normal_number FROM c""",
    "safe_filenames": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url || '/a b(c)', '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path,
        regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS short FROM pages)
      SELECT page_id, regexp_replace(string_split(path, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') || '.pdf' AS name,
        regexp_replace(string_split(rtrim(short, '/'), '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') || '.pdf' AS plain FROM p""",
    "quality_report": QUALITY_SQL,
}
