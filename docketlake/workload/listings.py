"""Listing rows derived from the given tables, parsed per court; page scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import courts
from docketlake.functions.text import rx, strip
from docketlake.operators import records as P
from docketlake.sources.html_rows import scan_rows
from docketlake.workload import duck as Q
from docketlake.workload.relational import read

_K = "o_orderkey"
# Portable SQL over orders: both engines derive the same captures.
DMY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '{s}' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '{s}' || CAST(year(o_orderdate) AS STRING)"
MON = "(CASE month(o_orderdate) WHEN 1 THEN 'JAN' WHEN 2 THEN 'FEB' WHEN 3 THEN 'MAR' WHEN 4 THEN 'APR' WHEN 5 THEN 'MAY' WHEN 6 THEN 'JUN' WHEN 7 THEN 'JUL' WHEN 8 THEN 'AUG' WHEN 9 THEN 'SEP' WHEN 10 THEN 'OCT' WHEN 11 THEN 'NOV' ELSE 'DEC' END)"
DASHED, SLASHED, DOTTED = (DMY.format(s=s) for s in "-/.")
DMON = f"CAST(day(o_orderdate) AS STRING) || '-' || {MON} || '-' || CAST(year(o_orderdate) AS STRING)"
SHORT_MON = f"lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '-' || {MON} || '-' || substr(CAST(year(o_orderdate) AS STRING), 3, 2)"
NO = f"CAST({_K} AS STRING)"
YEAR = "CAST(year(o_orderdate) AS STRING)"
CAPTURES = {
    "k": _K,
    "sc_title": f"CASE {_K} % 4 WHEN 0 THEN ' Civil Appeal No. ' || {NO} || '-K of ' || {YEAR} || ' and others' WHEN 1 THEN 'SMC No. ' || {NO} || ' of ' || {YEAR} WHEN 2 THEN 'Notice ' || {NO} ELSE ' ' END",
    "sc_date": f"CASE WHEN {_K} % 3 = 0 THEN '' ELSE {DASHED} END",
    "lhc_date": f"CASE WHEN {_K} % 2 = 0 THEN {DASHED} ELSE {SLASHED} END",
    "lhc_url": f"CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://a.b/' || {NO} WHEN 2 THEN '/p/' || {NO} ELSE {NO} || '.pdf' END",
    "shc_date": f"CASE WHEN {_K} % 2 = 0 THEN {SHORT_MON} ELSE lower({DMON}) END",
    "shc_url": f"CASE {_K} % 3 WHEN 0 THEN 'public/f.php?x=' || {NO} WHEN 1 THEN '/abs/' || {NO} ELSE '' END",
    "ihc_date": DMON,
    "ihc_path": f"CASE WHEN {_K} % 5 = 0 THEN '-' ELSE '/att/' || {NO} || '/1/a (b)[' || {NO} || '].pdf' END",
    "phc_case": f"CASE WHEN {_K} % 3 = 0 THEN 'Cell ' || {NO} ELSE ' W.P No. ' || {NO} || '-M of ' || {YEAR} || ' A Vs B ' END",
    "bhc_date": SLASHED,
    "bhc_name": f"CASE WHEN {_K} % 6 = 0 THEN '' ELSE 'f' || {NO} END",
    "fsc_title": f"CASE {_K} % 4 WHEN 0 THEN 'Shariat Petition No. ' || {NO} || '-I of ' || {YEAR} || ' dated ' || {DOTTED} WHEN 1 THEN 'Jail Criminal Appeal No. ' || {NO} || ' - Q - of ' || {YEAR} || ' (' || {DASHED} || ')' WHEN 2 THEN 'Cr.Rev.No. ' || {NO} || ' of ' || {YEAR} ELSE 'Other matter ' || {NO} END",
}
CAPTURES_SQL = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in CAPTURES.items())}, o_orderdate::DATE AS day FROM orders)"


def captures(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return orders.select(*(F.expr(v).alias(k) for k, v in CAPTURES.items()))


def supreme_records(spark, sf_dir):
    rows = captures(spark, sf_dir).select("k", F.col("sc_title").alias("title"), F.col("sc_date").alias("date"))
    return P.supreme(rows, ["k"]).select("k", "title", "case_number", "decision_date", "decision_date_parsed")


def lahore_records(spark, sf_dir):
    rows = captures(spark, sf_dir).select("k", F.col("lhc_date").alias("decision_date"), F.col("lhc_url").alias("pdf_url"))
    return P.lahore(rows, ["k"]).select("k", "decision_date_parsed", "pdf_url")


def sindh_records(spark, sf_dir):
    rows = captures(spark, sf_dir).select(
        "k", F.col("shc_date").alias("order_date"), F.col("shc_url").alias("pdf_url"),
        (F.col("k") % 9).alias("judge_id"), F.lit("J").alias("judge_name"),
    )
    return P.sindh(rows, ["k"]).select("k", "judge_id", "order_date_parsed", "pdf_url")


def islamabad_records(spark, sf_dir):
    """Each order as one API response, doubly encoded, parsed back to records."""
    c = captures(spark, sf_dir)
    record = F.to_json(F.array(F.struct(
        F.col("k").alias("O_ID"), F.col("ihc_date").alias("DDATE"), F.col("ihc_path").alias("ATTACHMENTS"),
        (F.col("k") % 2).alias("O_AFR"), F.lit("-").alias("O_CITATION"),
    )))
    body = F.to_json(F.struct(F.when(F.col("k") % 7 == 0, "empty").otherwise(record).alias("d")))
    rows = P.islamabad_api(c.select(body.alias("body"), F.lit("reported").alias("judgment_type")))
    return P.islamabad(rows).select("o_id", "decision_date_parsed", "pdf_url", "citation", "is_approved_for_reporting")


def peshawar_records(spark, sf_dir):
    rows = captures(spark, sf_dir).select("k", F.col("phc_case").alias("case"))
    return P.peshawar(rows, ["k"]).select("k", "case_number", "case_title")


def balochistan_records(spark, sf_dir):
    """One page per order with the embedded result, first record of each file id."""
    from docketlake.operators.dedup import first_per_group

    c = captures(spark, sf_dir)
    result = F.to_json(F.struct(F.array(F.struct(
        (F.col("k") % 5000).alias("FILE_ID"), F.col("k").alias("CASE_ID"), F.lit("2020").alias("FILE_FOLDER"),
        F.col("bhc_name").alias("FILE_NAME"), F.lit("doc").alias("FILE_EXT"), F.lit("A v. B").alias("CASE_TITLE"),
        F.col("bhc_date").alias("ORDER_DATE"),
    )).alias("records")))
    pages = c.select(F.concat(F.lit('<p/><div id="bhc-api-result" hidden>'), result, F.lit("</div>")).alias("html"))
    rows = P.embedded_json(pages).select(F.inline_outer("api.records"))
    firsts = first_per_group(P.balochistan(rows), ["file_id"], ["case_id"])
    return firsts.select("file_id", "case_id", "order_date_parsed", "pdf_url")


def shariat_records(spark, sf_dir):
    rows = captures(spark, sf_dir).select("k", F.col("fsc_title").alias("title"))
    return P.shariat_leading(rows, ["k"]).select("k", "case_number", "case_title", "case_type", "decision_date_parsed")


def common_counts(spark, sf_dir):
    """Records of three courts in the common view, counted per court and year."""
    c = captures(spark, sf_dir)
    views = {
        "SC": P.supreme(c.select(F.col("sc_title").alias("title"), F.col("sc_date").alias("date"))),
        "PHC": P.peshawar(c.select(F.col("phc_case").alias("case"), F.col("lhc_date").alias("decision_date"))),
        "FSC": P.shariat_leading(c.select(F.col("fsc_title").alias("title"))),
    }
    view = P.common_view(views)
    return view.groupBy("court_code", F.year("date").alias("year")).agg(F.count("*").alias("n"))


# ── pages ──
LINKS = {"base": "nav li", "fields": {"label": ("a", None), "href": ("a", "href")}}


def page_links(spark, sf_dir):
    """Navigation entries of every page, by selector."""
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    return scan_rows(pages, LINKS).select("page_id", F.col("row_no").cast("bigint").alias("row_no"), "href")


def page_headings(spark, sf_dir):
    """Case metadata rules applied to the first heading of each page."""
    pages = read(spark, sf_dir, "pages", "page_id", F.col("url").alias("page_url"), "html")
    found = P.commonlii_cases(pages, heading="h1")
    plain = ~F.coalesce(F.col("title"), F.lit("")).contains("&")
    return found.select("page_id", "error", F.length("title").cast("bigint").alias("chars"), plain.alias("decoded"), "pdf_url")


def page_tests(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    html, no = F.col("html"), F.col("page_id") % 5
    return pages.select(
        "page_id",
        courts.is_maintenance_page(F.concat(html, F.when(F.col("page_id") % 9 == 0, "site under MAINTENANCE").otherwise(""))).alias("maintenance"),
        courts.has_next_page(F.concat(html, F.lit('<a href="/page/3/">')), no).alias("has_next"),
        courts.is_refused_page(html).alias("refused"),
    )


# ── chat answers ──
# Clean-up steps of an answer, in order; the last one sets the heading.
ANSWER_STEPS = [
    (r"【\d+:\d+†source】", "", ""),
    (r"\\n\\n\d+\.\s*", "\n", ""),
    (r"Recommendations:\s*\\n\\n", "### Recommendations:\n", ""),
    (r"(\n#+ .+)\n:", "$1:", ""),
    (r"•\s*", "- ", ""),
    (r"\n{3,}", "\n", ""),
    (r"\\n\\n", "\n", ""),
]
ANSWER_HEADING = "### Analysis\n"


def clean_answer(text):
    for pattern, by, flags in ANSWER_STEPS:
        text = F.regexp_replace(text, rx(pattern, flags), by)
    return F.concat(F.lit(ANSWER_HEADING), strip(text))


def answers_cleaned(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("role = 'assistant'")
    dressed = F.concat(F.lit("【1:2†source】• "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n")), F.lit(r"\n\n3. end\n\n"))
    return turns.select("conv_id", "turn", F.md5(clean_answer(dressed)).alias("digest"))


def _answers_sql() -> str:
    x = "'【1:2†source】• ' || replace(text, chr(10), repeat(chr(10), 4)) || '\\n\\n3. end\\n\\n'"
    for pattern, by, _ in ANSWER_STEPS:
        target = by.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{target}', 'g')"
    return f"SELECT conv_id, turn, md5('### Analysis' || chr(10) || {Q.strip(x)}) AS digest FROM conversations WHERE role = 'assistant'"


QUERIES = {
    "supreme_records": supreme_records,
    "lahore_records": lahore_records,
    "sindh_records": sindh_records,
    "islamabad_records": islamabad_records,
    "peshawar_records": peshawar_records,
    "balochistan_records": balochistan_records,
    "shariat_records": shariat_records,
    "common_counts": common_counts,
    "page_links": page_links,
    "page_headings": page_headings,
    "page_tests": page_tests,
    "answers_cleaned": answers_cleaned,
}
_FSC_TYPE = "CASE k % 4 WHEN 0 THEN 'Shariat Petition' WHEN 1 THEN 'Jail Criminal Appeal' WHEN 2 THEN 'Criminal Revision' ELSE 'Other' END"
_FSC_NUMBER = "CASE WHEN k % 4 = 3 THEN fsc_title ELSE regexp_extract(fsc_title, '^(.*? of \\d{4})', 1) END"
ORACLES = {
    "supreme_records": f"""SELECT k, trim(sc_title) AS title, CASE WHEN k % 4 < 2 THEN regexp_extract(trim(sc_title), '^.*? of \\d{{4}}') ELSE trim(sc_title) END AS case_number,
      sc_date AS decision_date, CASE WHEN sc_date <> '' THEN day END AS decision_date_parsed FROM {CAPTURES_SQL} WHERE trim(sc_title) <> ''""",
    "lahore_records": f"""SELECT k, day AS decision_date_parsed, CASE k % 4 WHEN 2 THEN 'https://sys.lhc.gov.pk' || lhc_url
      WHEN 3 THEN 'https://sys.lhc.gov.pk/appjudgments/' || lhc_url ELSE lhc_url END AS pdf_url FROM {CAPTURES_SQL}""",
    "sindh_records": f"""SELECT k, k % 9 AS judge_id, day AS order_date_parsed, CASE k % 3 WHEN 0 THEN 'https://caselaw.shc.gov.pk/caselaw/' || shc_url
      WHEN 1 THEN 'https://caselaw.shc.gov.pk' || shc_url ELSE '' END AS pdf_url FROM {CAPTURES_SQL}""",
    "islamabad_records": f"""SELECT k AS o_id, day AS decision_date_parsed, CASE WHEN k % 5 = 0 THEN '' ELSE 'https://mis.ihc.gov.pk/att/' || k || '/1/a%20%28b%29%5B' || k || '%5D.pdf' END AS pdf_url,
      '' AS citation, k % 2 = 1 AS is_approved_for_reporting FROM {CAPTURES_SQL} WHERE k % 7 <> 0""",
    "peshawar_records": f"""SELECT k, CASE WHEN k % 3 = 0 THEN phc_case ELSE regexp_extract(trim(phc_case), '^(.+?of \\d{{4}}) (.+)$', 1) END AS case_number,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'A Vs B' END AS case_title FROM {CAPTURES_SQL}""",
    "balochistan_records": f"""SELECT k % 5000 AS file_id, k AS case_id, day AS order_date_parsed,
      CASE WHEN bhc_name = '' THEN '' ELSE 'https://api.bhc.gov.pk/v2/downloadpdf/2020/' || bhc_name || '.doc' END AS pdf_url
      FROM {CAPTURES_SQL} QUALIFY row_number() OVER (PARTITION BY k % 5000 ORDER BY k) = 1""",
    "shariat_records": f"""WITH c AS (SELECT *, {_FSC_NUMBER} AS case_number FROM {CAPTURES_SQL})
      SELECT k, case_number, coalesce(nullif(trim(replace(fsc_title, case_number, ''), ' -–—().,'), ''), fsc_title) AS case_title,
        {_FSC_TYPE} AS case_type, CASE WHEN k % 4 < 2 THEN day END AS decision_date_parsed FROM c""",
    "common_counts": f"""WITH c AS (SELECT * FROM {CAPTURES_SQL}), v AS (
      SELECT 'SC' AS court_code, CASE WHEN sc_date <> '' THEN day END AS d FROM c WHERE trim(sc_title) <> '' UNION ALL
      SELECT 'PHC', CASE WHEN k % 2 = 0 THEN day END FROM c UNION ALL SELECT 'FSC', CASE WHEN k % 4 < 2 THEN day END FROM c)
      SELECT court_code, year(d)::INT AS year, count(*) AS n FROM v GROUP BY ALL""",
    "page_links": """SELECT page_id, i - 1 AS row_no, h AS href FROM (SELECT page_id,
      unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)"', 1)) AS h,
      generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)"', 1), 1) AS i FROM pages)""",
    "page_headings": r"""WITH h AS (SELECT page_id, html, regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g') AS raw FROM pages),
      t AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM h)
      SELECT page_id, NULL::VARCHAR AS error, length(title) AS chars, NOT contains(title, '&') AS decoded, NULL::VARCHAR AS pdf_url FROM t""",
    "page_tests": """SELECT page_id, page_id % 9 = 0 AS maintenance, page_id % 5 = 2 AS has_next,
      contains(lower(html), 'captcha') OR contains(lower(html), 'rate limit') AS refused FROM pages""",
    "answers_cleaned": _answers_sql(),
}
