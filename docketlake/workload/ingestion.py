"""Model-answer parsing, payloads and points over derived judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.operators import passes as P
from docketlake.operators.extraction import TIER_A, extract_tier_a
from docketlake.operators.layouts import POINT_TYPES
from docketlake.operators.collection import latest
from docketlake.operators.points import build_points
from docketlake.operators.reports import fill_rate, point_type_counts
from docketlake.workload import duck as Q
from docketlake.workload import judgments as J
from docketlake.workload import relational as R
from docketlake.workload.relational import read
from docketlake.workload.segments import _MARKED_SQL, LONG, numbered_documents

# Answers as a model would give them: fenced, grouped, with mixed types.
_K = "o_orderkey"
ANSWER = (
    "'```json' || chr(10) || '{\"judgment_type\": ' || CASE " + _K + " % 4 WHEN 0 THEN '\"conviction\"' WHEN 1 THEN '\"acquittal\"' WHEN 2 THEN '\"odd\"' ELSE 'null' END"
    " || ', \"injury_count\": ' || CASE " + _K + " % 3 WHEN 0 THEN '\"' || CAST(" + _K + " AS STRING) || '\"' WHEN 1 THEN CAST(" + _K + " AS STRING) || '.5' ELSE '\"x\"' END"
    " || ', \"motive_proven\": ' || CASE " + _K + " % 5 WHEN 0 THEN 'true' WHEN 1 THEN '\"yes\"' WHEN 2 THEN '\"no\"' WHEN 3 THEN '1' ELSE '\"None\"' END"
    " || ', \"brutality_level\": \"top\", \"Sentencing\": {\"brutality_level\": \"' || o_orderpriority || '\", \"aggravating_factors\": [\"a\", null, \"n/a\", \"b' || CAST(" + _K + " % 7 AS STRING) || '\"]}}' || chr(10) || '```'"
)
POINTS_ANSWER = (
    "'{\"points\": [{\"point_type\": \"facts\", \"text\": \"The facts of case ' || CAST(" + _K + " AS STRING) || '\", \"extraction_confidence\": 1.5},"
    " {\"point_type\": \"' || CASE " + _K + " % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'court_reasoning' ELSE 'bad' END || '\", \"text\": \"A question of law here\"},"
    " {\"point_type\": \"final_order\", \"text\": \"' || CASE " + _K + " % 2 WHEN 0 THEN 'Appeal dismissed.' ELSE 'short' END || '\", \"evidence_type\": \"oral\"}], \"total_issues\": 1}'"
)


def _answers(spark, sf_dir, sql):
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.expr(sql).alias("answer"))


CLASSIFIED = ("judgment_type", "injury_count", "motive_proven", "brutality_level", "aggravating_factors")


def tier_b_coerced(spark, sf_dir):
    parsed = P.parse_tier_b(_answers(spark, sf_dir, ANSWER), fields=CLASSIFIED)
    b = F.col("tier_b")
    return parsed.select(
        "o_orderkey", b["judgment_type"].alias("judgment_type"), b["injury_count"].alias("injury_count"),
        b["motive_proven"].alias("motive_proven"), b["brutality_level"].alias("brutality_level"),
        F.array_join(b["aggravating_factors"], ",").alias("factors"), F.array_join("tier_b_rejects", ",").alias("rejects"),
    )


def points_parsed(spark, sf_dir):
    parsed = P.parse_points(_answers(spark, sf_dir, POINTS_ANSWER))
    rows = parsed.select("o_orderkey", "points_meta.skipped_count", F.explode_outer("points").alias("p"))
    return rows.select("o_orderkey", "skipped_count", "p.sequence", "p.point_type", "p.text", "p.extraction_confidence")


def point_checks(spark, sf_dir):
    """Counts per point type and the structural warnings, per case."""
    parsed = P.parse_points(_answers(spark, sf_dir, POINTS_ANSWER))
    counts = point_type_counts(parsed.select("o_orderkey", "points"), "points", "point_type", POINT_TYPES)
    return counts.select("o_orderkey", "facts", "issue", "court_reasoning", "final_order", F.array_join("warnings", "; ").alias("warnings"))


COVERED = ("case_number", "court_name", "ppc_sections", "fir_number", "victim_relationship", "date_filed")


def tier_a_coverage(spark, sf_dir):
    out = extract_tier_a(J.judgments(spark, sf_dir), fields=COVERED)
    return out.select("judgment_id", fill_rate("tier_a", {f: TIER_A[f] for f in COVERED}).alias("tier_a_pct"))


def _coverage_sql() -> str:
    from docketlake.workload import extraction as E

    return f"""WITH i AS ({E.IDENTITY_SQL}), c AS ({E.CITED_SQL}), d AS ({E.DATES_SQL})
      SELECT judgment_id, round(((case_number IS NOT NULL)::INT + (court_name IS NOT NULL)::INT + (ppc_sections <> '')::INT +
        (fir_number IS NOT NULL)::INT + (date_filed IS NOT NULL)::INT) * 100.0::DOUBLE / 6, 1) AS tier_a_pct
      FROM i JOIN c USING (judgment_id) JOIN d USING (judgment_id)"""


def points_of_documents(spark, sf_dir):
    """Documents as judgments: full-text points for short ones, chunk points for long ones.

    A long text that cannot be split, having no second line, stays one full-text point.
    """
    docs = numbered_documents(spark, sf_dir).select(
        F.lit("SC").alias("court"), F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("case_number"), "text"
    )
    points = build_points(docs, single_limit=LONG)
    return points.groupBy("case_number", "parent_case_id").agg(
        F.min("point_type").alias("kind"), (F.count("*") == F.coalesce(F.max("total_chunks"), F.lit(1))).alias("complete"),
        (F.count("*") == F.count_distinct("point_uuid")).alias("unique_ids"),
    )


def latest_points(spark, sf_dir):
    """Two loads of the same points, the second newer for some: last version per id."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    first = orders.select(F.concat(F.lit("p"), (F.col("o_orderkey") % 4000).cast("string")).alias("point_uuid"), F.col("o_orderkey").alias("version"))
    return latest(first.unionByName(first.filter("version % 2 = 0")), "version")


QUERIES = {
    "tier_b_coerced": tier_b_coerced,
    "points_parsed": points_parsed,
    "point_checks": point_checks,
    "tier_a_coverage": tier_a_coverage,
    "points_of_documents": points_of_documents,
    "latest_points": latest_points,
}
ORACLES = {
    "tier_b_coerced": f"""SELECT {_K}, CASE {_K} % 4 WHEN 0 THEN 'conviction' WHEN 1 THEN 'acquittal' END AS judgment_type,
      CASE WHEN {_K} % 3 < 2 THEN {_K} END AS injury_count, CASE {_K} % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS motive_proven,
      o_orderpriority AS brutality_level, 'a,b' || ({_K} % 7) AS factors, CASE WHEN {_K} % 4 = 2 THEN 'judgment_type=odd' ELSE '' END AS rejects FROM orders""",
    "points_parsed": f"""WITH p AS (SELECT {_K}, (CASE WHEN {_K} % 3 = 2 THEN 1 ELSE 0 END + {_K} % 2)::INT AS skipped_count, u.* FROM orders,
        LATERAL (SELECT unnest([1, 2, 3]) AS i) u)
      SELECT {_K}, skipped_count, (row_number() OVER (PARTITION BY {_K} ORDER BY i) - 1)::INT AS sequence,
        CASE i WHEN 1 THEN 'facts' WHEN 2 THEN CASE {_K} % 3 WHEN 0 THEN 'issue' ELSE 'court_reasoning' END ELSE 'final_order' END AS point_type,
        CASE i WHEN 1 THEN 'The facts of case ' || {_K} WHEN 2 THEN 'A question of law here' ELSE 'Appeal dismissed.' END AS text,
        CASE i WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS extraction_confidence
      FROM p WHERE i = 1 OR (i = 2 AND {_K} % 3 < 2) OR (i = 3 AND {_K} % 2 = 0)""",
    "point_checks": f"""SELECT {_K}, 1 AS facts, ({_K} % 3 = 0)::INT AS issue, ({_K} % 3 = 1)::INT AS court_reasoning, ({_K} % 2 = 0)::INT AS final_order,
      concat_ws('; ', CASE WHEN {_K} % 2 = 1 THEN 'missing final_order' END, CASE WHEN {_K} % 3 <> 1 THEN 'missing court_reasoning' END) AS warnings FROM orders""",
    "tier_a_coverage": _coverage_sql(),
    "points_of_documents": f"""WITH d AS (SELECT doc_id, text, {R._md5_sql("('SC:D ' || doc_id)")} AS h FROM ({_MARKED_SQL}))
      SELECT 'D ' || doc_id AS case_number, {R.UUID_SQL} AS parent_case_id, CASE WHEN length({Q.strip('text')}) > {LONG} AND contains({Q.strip('text')}, chr(10)) THEN 'chunk' ELSE 'full_text' END AS kind,
        true AS complete, true AS unique_ids FROM d WHERE {Q.strip('text')} <> ''""",
    "latest_points": f"SELECT 'p' || ({_K} % 4000) AS point_uuid, max({_K}) AS version FROM orders GROUP BY 1",
}
