"""The whole way: listings → records → texts → extraction → points → collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.courts import is_maintenance_page
from docketlake.functions.text import truncate_middle
from docketlake.operators import passes
from docketlake.operators import records as P
from docketlake.operators.dedup import first_by_url, first_per_group, limit_per_group, limit_rows
from docketlake.operators.embedding import HashingEmbedder, embed_column
from docketlake.operators.extraction import TIER_A, extract_tier_a
from docketlake.operators.layouts import TIER_B, TIER_C, VOCABULARIES
from docketlake.operators.points import build_points, reject_reason, upsert
from docketlake.operators.quality import validate
from docketlake.operators.reports import counts_by_each, fill_rate, run_summary
from docketlake.operators.search import with_sparse
from docketlake.sources.html_rows import SCHEMAS, scan_rows

# Court → (row schema, record parser, grouping columns of the summary).
COURTS = {
    "SC": ("SC", P.supreme, []),
    "LHC": ("LHC", P.lahore, ["category"]),
    "SHC": ("SHC", P.sindh, ["case_type", "judge_name"]),
    "PHC": ("PHC", P.peshawar, ["category"]),
    "FSC": ("FSC_LEADING", P.shariat_leading, ["case_type"]),
    "COMMONLII": ("COMMONLII", P.commonlii_links, []),
    # JSON sources: the record parser runs on rows of the response, not of a table.
    "IHC": (None, P.islamabad, ["judgment_type"]),
    "BHC": (None, P.balochistan, ["type_name", "author_judge"]),
}
OMITTED = "\n\n[...MIDDLE SECTION OMITTED...]\n\n"


def _listing_rows(pages: DataFrame, court: str) -> DataFrame:
    """Rows of the captured pages or API responses of one court."""
    if court == "IHC":
        if "judgment_type" not in pages.columns:
            pages = pages.withColumn("judgment_type", F.lit("reported"))
        rows = P.islamabad_api(pages, "html")
        return rows.filter(F.col("api_error").isNull()).withColumn("row_no", F.col("O_ID"))
    if court == "BHC":
        keep = [c for c in pages.columns if c != "html"]
        rows = P.embedded_json(pages).select(*keep, F.inline_outer("api.records"))
        return rows.filter(F.col("FILE_ID").isNotNull() | F.col("CASE_ID").isNotNull()).withColumn("row_no", F.col("CASE_ID"))
    usable = pages.filter(~is_maintenance_page(F.col("html")))
    return scan_rows(usable, SCHEMAS[COURTS[court][0]])


def crawl(pages: DataFrame, court: str, limit: int | None = None, category: str | None = None, per_year: int | None = None) -> DataFrame:
    """Captured pages (page, html, source_url …) → unique records in page order.

    Maintenance pages carry no rows. Records without a link are all kept.
    """
    parse = COURTS[court][1]
    rows = _listing_rows(pages, court)
    order = [c for c in ("year", "page", "row_no") if c in rows.columns]
    # The common 'year' of a link wins over the page's own.
    keep = [c for c in order if not (court == "COMMONLII" and c == "year")]
    found = parse(rows, keep)
    if category:
        found = P.by_category(found, category)
    record_id = {"IHC": "o_id", "BHC": "file_id"}.get(court)
    if record_id:
        found = first_per_group(found, [record_id], keep)
    url = "url" if court == "COMMONLII" else "pdf_url"
    unique = first_by_url(found, url, keep)
    if per_year:
        unique = limit_per_group(unique, "year", keep, per_year)
    return limit_rows(unique, limit, keep)


def write_run(results: DataFrame, path: str, court: str, failed: DataFrame | None = None) -> None:
    """JSON lines with nulls kept, and the summary beside them; ``failed`` requests are counted in it."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
    stored = results.sparkSession.read.schema(results.schema).json(f"{path}/results")
    summary = run_summary(stored)
    if failed is not None:
        summary = summary.withColumn("failed_requests", failed.agg(F.count("*")).scalar())
    summary.write.mode("overwrite").json(f"{path}/summary")
    groups = COURTS[court][2]
    if groups:
        counts_by_each(stored, groups).write.mode("overwrite").json(f"{path}/counts")


def classification_prompt() -> str:
    """Request for the classification pass, made from the record layout."""
    lines = [
        f"- {field}: {kind}" + (f", one of {', '.join(VOCABULARIES[field])}" if field in VOCABULARIES else "")
        for field, kind in TIER_B.items()
    ]
    return "Classify this criminal judgment. Answer with one JSON object; null where unknown.\n" + "\n".join(lines) + "\n\n"


def passage_prompt() -> str:
    fields = "\n".join(f"- {f}" for f in TIER_C)
    return f"Extract these passages of the judgment. Answer with one JSON object; null where absent.\n{fields}\n\n"


POINTS_PROMPT = "Decompose the judgment into self-contained reasoning points. Answer as {\"points\": [...], \"total_issues\": n}.\n\n"


def extract(docs: DataFrame, factory: Callable[[], object] | None = None, source_url: str | None = None) -> DataFrame:
    """Adds tier_a, and with a provider tier_b, tier_c and points, plus metadata.

    Every pass keeps its own error; a failed pass leaves its record empty.
    """
    out = extract_tier_a(docs, source_url=source_url)
    text = F.col("text")
    requests = {
        "b": F.concat(F.lit(classification_prompt()), truncate_middle(text, 25_000, 12_000, 12_000, OMITTED)),
        "c": F.concat(F.lit(passage_prompt()), truncate_middle(text, 30_000, 15_000, 15_000, OMITTED)),
        "p": F.concat(
            F.lit(POINTS_PROMPT),
            truncate_middle(text, 30_000, 18_000, 12_000, "\n\n[...MIDDLE SECTION OMITTED FOR LENGTH...]\n\n"),
        ),
    }
    for name, request in requests.items():
        if factory is None:
            out = out.withColumns({f"__{name}": F.lit(None).cast("string"), f"__{name}_error": F.lit(None).cast("string")})
        else:
            out = passes.ask(out.withColumn("__request", request), "__request", factory, f"__{name}").drop("__request")
    out = passes.parse_tier_b(out, "__b", "tier_b")
    out = passes.parse_tier_c(out, "__c", "tier_c")
    out = passes.parse_points(out, "__p", "points")
    meta = F.struct(
        F.length("text").alias("text_length"), F.col("__b_error").alias("tier_b_error"),
        F.col("__c_error").alias("tier_c_error"), F.col("__p_error").alias("reasoning_error"),
        F.size("points").alias("reasoning_point_count"), fill_rate("tier_a", TIER_A).alias("tier_a_pct"),
        fill_rate("tier_b", TIER_B).alias("tier_b_pct"), fill_rate("tier_c", dict.fromkeys(TIER_C, "string")).alias("tier_c_pct"),
    )
    return out.withColumn("extraction_metadata", meta).drop(*(f"__{n}{s}" for n in requests for s in ("", "_error")))


def summarize(docs: DataFrame, factory: Callable[[], object], into: str = "summary") -> DataFrame:
    """Adds a short summary for chunk prefixes; '' for texts below 200 characters and on failure."""
    text = truncate_middle(F.col("text"), 12_000, 8_000, 4_000, "\n\n[...middle truncated...]\n\n")
    request = F.when(F.length("text") >= 200, F.concat(F.lit('Summarize this judgment in 50 to 100 words as {"summary": "..."}.\n\n'), text))
    out = passes.ask(docs.withColumn("__request", request), "__request", factory, "__s")
    return out.withColumn(into, passes.parse_summary(F.col("__s"))).drop("__request", "__s", "__s_error")


# What a stored point carries of its judgment: display fields and every field that filters may name.
PAYLOAD = ["case_title", "case_type", "court_level", "jurisdiction_province", "date_judgment", "judge_names", "ppc_sections"]
CLASSIFIED = ["judgment_type", "offense_category", "severity_level", "special_law", "appeal_outcome", "sentence_type"]


def _gated(extracted: DataFrame) -> DataFrame:
    gated = validate(extracted, TIER_A, payload="tier_a")
    return gated.withColumn("case_number", F.coalesce("case_number", "tier_a.case_number"))


def to_points(extracted: DataFrame, embedder: Callable[[], object] = HashingEmbedder) -> DataFrame:
    """Extracted judgments that pass the gate → points with both vectors. The others are in ``rejected``."""
    fields = {f: F.col(f"tier_a.{f}") for f in PAYLOAD} | {f: F.col(f"tier_b.{f}") for f in CLASSIFIED}
    flat = _gated(extracted).filter("report.passed").withColumns(fields)
    points = build_points(flat, list(fields), tier_c="tier_c", reasoning="points")
    return embed_column(with_sparse(points), "text", embedder)


def rejected(extracted: DataFrame) -> DataFrame:
    """The judgments that ``to_points`` leaves out, with ``reject_reason``: the gate's errors, or why no key can be made."""
    key = reject_reason(F.col("text"), F.col("court"), F.col("case_number"))
    failed = F.when(~F.col("report.passed"), F.array_join("report.errors", "; ")).otherwise(key)
    return _gated(extracted).withColumn("reject_reason", failed).filter("reject_reason is not null").drop("report")


def ingest(spark: SparkSession, points: DataFrame, path: str, version: int) -> None:
    upsert(spark, points.withColumn("version", F.lit(version)), path, "version")
