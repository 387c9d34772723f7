"""Listing rows → judgment records, one function per court, and the common view.

Input rows carry string columns as captured (missing ones may be absent); results
have the court's own columns. Extra input columns, such as the page, are dropped
except ``source_url`` and those named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import courts, dates
from docketlake.functions import records as R
from docketlake.functions.text import (
    first, head, squash, strip, text_or_empty, try_long,
)
from docketlake.operators.dedup import first_per_group, priority_union
from docketlake.sources.sites import COURT_BENCH_TYPES


def _reader(df: DataFrame):
    """Trimmed column by name, '' when the capture has no such column."""

    def get(name: str) -> Column:
        return text_or_empty(F.col(name)) if name in df.columns else F.lit("")

    return get


def _build(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    source = F.col("source_url") if "source_url" in df.columns else F.lit("")
    return df.select(*keep, *(v.alias(k) for k, v in columns.items()), source.alias("source_url"))


def supreme(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    raw_date = F.when(g("date_attr") != "", g("date_attr")).otherwise(g("date"))
    out = _build(
        df, keep, title=g("title"), case_number=R.supreme_number(g("title")), post_url=g("post_url"),
        pdf_url=g("pdf_url"), decision_date=raw_date, decision_date_parsed=dates.supreme_date(raw_date),
        bench=F.lit(""), summary=head(g("summary"), 500),
    )
    return out.filter(F.col("title") != "")


def lahore(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    plain = ("case_number", "case_title", "judge_name", "lhc_citation", "other_citation", "category", "decision_date")
    return _build(
        df, keep, serial=R.serial(g("serial")), **{n: g(n) for n in plain},
        decision_date_parsed=dates.lahore_date(g("decision_date")), pdf_url=R.lahore_pdf(g("pdf_url")),
    )


# Column headers of the two table captures.
LAHORE_HEADERS = ["S.No", "Case No", "Case Title", "Judge Name", "LHC Citation", "Other Citation", "Category",
                  "Decision Date", "Judgment"]
PESHAWAR_HEADERS = ["S.No", "Case", "Remarks", "Other Citation", "PHC Neutral Citation", "Decision Date",
                    "S.C.Status", "Category", "Judgment", "SC Judgment"]


def table_rows(df: DataFrame, names: list[str], min_width: int, headers: str = "headers", row: str = "row") -> DataFrame:
    """Adds map ``cells`` of header → cell. Without headers cells go by position, and
    rows narrower than ``min_width`` are left out."""
    h, r = F.col(headers), F.col(row)
    no_headers = h.isNull() | (F.size(h) == 0)
    labels = F.when(no_headers, F.array(*(F.lit(n) for n in names))).otherwise(h)
    width = F.least(F.size(labels), F.size(r))
    cells = F.map_from_arrays(F.slice(labels, 1, width), F.slice(r, 1, width))
    return df.filter(~no_headers | (F.size(r) >= min_width)).withColumn("cells", cells)


def lahore_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rows = table_rows(df, LAHORE_HEADERS, 8)
    names = dict(zip(("serial", "case_number", "case_title", "judge_name", "lhc_citation", "other_citation",
                      "category", "decision_date"), LAHORE_HEADERS))
    rows = rows.withColumns({n: F.try_element_at("cells", F.lit(label)) for n, label in names.items()})
    link = R.lahore_pdf_of_cell(F.try_element_at("cells", F.lit("Judgment")))
    return lahore(rows.withColumn("pdf_url", F.coalesce(link, F.lit(""))), keep)


def peshawar_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rows = table_rows(df, PESHAWAR_HEADERS, 9)
    names = dict(zip(("serial", "case", "remarks", "other_citation", "neutral_citation", "decision_date",
                      "sc_status", "category"), PESHAWAR_HEADERS))
    rows = rows.withColumns({n: F.try_element_at("cells", F.lit(label)) for n, label in names.items()})
    return peshawar(rows.drop("pdf_url", "sc_pdf_url"), keep)


def sindh(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Needs columns judge_id and judge_name of the page's judge."""
    g = _reader(df)
    plain = ("citation", "case_type", "case_year", "parties", "order_date", "afr", "head_notes", "bench",
             "apex_court", "apex_status")
    return _build(
        df, keep, serial=R.serial(g("serial")), case_number=squash(g("case_number")), **{n: g(n) for n in plain},
        order_date_parsed=dates.sindh_date(g("order_date")), pdf_url=R.sindh_pdf(g("pdf_url")),
        judge_id=F.col("judge_id"), judge_name=F.col("judge_name"),
    )


def sindh_judges(df: DataFrame) -> DataFrame:
    """Judges dimension; rows without an id in their link are left out."""
    judge_id = try_long(first(F.col("total_url"), r"/(\d+)/-1"))
    return df.select(
        judge_id.alias("judge_id"), text_or_empty(F.col("judge_name")).alias("judge_name"),
        R.count_or_zero(F.col("total")).alias("total"), R.count_or_zero(F.col("afr")).alias("afr"),
    ).filter(F.col("judge_id").isNotNull())


ISLAMABAD_TYPE = (
    "array<struct<O_ID:bigint,CASENO:string,TITLE:string,PARTIES:string,DDATE:string,ATTACHMENTS:string,"
    "BENCHNAME:string,AUTHOR_JUDGES:string,O_CITATION:string,O_AFR:int,ISLANDMARK:int,O_SUBJECT:string,"
    "O_REMARKS:string,O_UNDERSECTION:string,O_IHC_HEADNOTE:string,O_SC_STATUS:string,O_SC_CITATION:string,"
    "O_SC_ATTACHMENTS:string,CASECODE:bigint>>"
)


def islamabad_api(responses: DataFrame, body: str = "body") -> DataFrame:
    """API responses → one row per record plus ``api_error``.

    The body is {"d": text}, the text again JSON: an array, or "empty" for none.
    Anything else becomes one row with an error instead of failing the job.
    """
    inner = F.get_json_object(F.col(body), "$.d")
    keep = [c for c in responses.columns if c != body]
    staged = responses.select(*keep, inner.alias("__inner"))
    none = F.lower(strip(F.col("__inner"))).isin("", "empty", '"empty"', "[]", "null")
    is_list = strip(F.col("__inner")).startswith("[")
    items = F.from_json(F.when(is_list, F.col("__inner")), ISLAMABAD_TYPE)
    error = F.when(F.col("__inner").isNull(), "invalid JSON response").when(~none & items.isNull(), "unexpected inner JSON")
    staged = staged.select(*keep, items.alias("__items"), error.alias("api_error"))
    rows = staged.select(*keep, "api_error", F.explode_outer("__items").alias("__r"))
    return rows.select(*keep, "api_error", "__r.*").filter(F.col("O_ID").isNotNull() | F.col("api_error").isNotNull())


def islamabad_judges(responses: DataFrame, body: str = "body") -> DataFrame:
    """Judges dimension from API responses of the same wrapping; rows without an id are left out."""
    inner = F.get_json_object(F.col(body), "$.d")
    items = F.from_json(F.when(strip(inner).startswith("["), inner), "array<struct<JUDGE_ID:bigint,JUG_REALNAME:string,ISRETIRED:int>>")
    rows = responses.select(F.explode(items).alias("r")).filter("r.JUDGE_ID IS NOT NULL")
    name = F.coalesce(F.nullif(strip(F.col("r.JUG_REALNAME")), F.lit("")), F.lit("Unknown"))
    return rows.select(F.col("r.JUDGE_ID").alias("judge_id"), name.alias("judge_name"), F.coalesce(F.col("r.ISRETIRED") != 0, F.lit(False)).alias("retired"))


def islamabad(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Needs column judgment_type (reported, important or keyword_search)."""
    g = _reader(df)
    clean = {"citation": "O_CITATION", "subject": "O_SUBJECT", "remarks": "O_REMARKS", "under_section": "O_UNDERSECTION",
             "headnote": "O_IHC_HEADNOTE", "sc_status": "O_SC_STATUS", "sc_citation": "O_SC_CITATION"}
    return _build(
        df, keep, o_id=F.coalesce(F.col("O_ID"), F.lit(0)), case_number=g("CASENO"), case_title=g("TITLE"),
        parties=g("PARTIES"), decision_date=g("DDATE"), decision_date_parsed=dates.islamabad_date(g("DDATE")),
        bench=g("BENCHNAME"), author_judge=g("AUTHOR_JUDGES"),
        **{n: R.islamabad_text(F.col(c)) for n, c in clean.items()},
        is_approved_for_reporting=F.coalesce(F.col("O_AFR") != 0, F.lit(False)),
        is_landmark=F.coalesce(F.col("ISLANDMARK") != 0, F.lit(False)),
        sc_pdf_url=R.islamabad_pdf(F.col("O_SC_ATTACHMENTS")), pdf_url=R.islamabad_pdf(F.col("ATTACHMENTS")),
        case_code=F.coalesce(F.col("CASECODE"), F.lit(0)), judgment_type=F.col("judgment_type"),
    )


def islamabad_all(reported: DataFrame, important: DataFrame, order: Sequence[str]) -> DataFrame:
    """Both kinds by o_id; the reported record wins."""
    return priority_union(
        first_per_group(reported, ["o_id"], order), first_per_group(important, ["o_id"], order), "o_id"
    )


def keyword_search(df: DataFrame, keyword: str, year: int | None = None) -> DataFrame:
    """Records that mention ``keyword``; zero and None mean any year."""
    fields = ("case_title", "parties", "subject", "headnote", "remarks")
    hit = F.lower(F.concat_ws("\n", *fields)).contains(keyword.lower())
    return df.filter(hit & (F.year("decision_date_parsed") == year) if year else hit)


def peshawar(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    number, title = R.peshawar_case(g("case"))
    plain = ("remarks", "other_citation", "neutral_citation", "decision_date", "sc_status", "category", "pdf_url",
             "sc_pdf_url")
    return _build(
        df, keep, serial=R.serial(g("serial")), case_number=number, case_title=title, **{n: g(n) for n in plain},
        decision_date_parsed=dates.peshawar_date(g("decision_date")),
    )


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    """Case-insensitive equality; an empty category keeps all rows."""
    return df.filter(F.lower("category") == category.lower()) if category else df


BALOCHISTAN_TYPE = (
    "struct<error:string,auth_token:string,api_base_url:string,"
    "courts:array<struct<COURT_ID:bigint,COURT_NAME:string,COURT_TYPE:string>>,"
    "judges:array<struct<JUDGE_ID:bigint,JUDGE_NAME:string,TOTAL_ORDERS:string>>,"
    "records:array<struct<FILE_ID:bigint,FILE_FOLDER:string,FILE_NAME:string,FILE_EXT:string,CASE_ID:bigint,"
    "CASE_TITLE:string,REGISTER_NUMBER:string,AUTHOR_JUDGE:string,TYPE_NAME:string,ORDER_DATE:string>>>"
)


def embedded_json(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds struct ``api`` read from the page's hidden result element, and ``api_error``."""
    text = first(F.col(html), r"""id="bhc-api-result"[^>]*>([^<]+)""")
    staged = pages.withColumn("__json", text).withColumn("api", F.from_json("__json", BALOCHISTAN_TYPE))
    valid = F.try_parse_json("__json").isNotNull()
    error = (
        F.when(F.col("__json").isNull(), "no result element")
        .when(~valid, "invalid result JSON")
        .otherwise(F.col("api.error"))
    )
    return staged.withColumn("api_error", error).drop("__json")


def bench_courts(pages: DataFrame) -> DataFrame:
    """Courts whose type is a high-court bench or a tribunal."""
    rows = pages.select(F.inline_outer("api.courts"))
    return rows.filter(rows["COURT_TYPE"].try_cast("int").isin(COURT_BENCH_TYPES))


def active_judges(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.inline_outer("api.judges"))
    return rows.filter(rows["TOTAL_ORDERS"].try_cast("int") > 0)


def balochistan(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    return _build(
        df, keep, file_id=F.coalesce(F.col("FILE_ID"), F.lit(0)), case_id=F.coalesce(F.col("CASE_ID"), F.lit(0)),
        case_number=g("REGISTER_NUMBER"), case_title=strip(R.decode_entities(F.coalesce(F.col("CASE_TITLE"), F.lit("")))),
        author_judge=g("AUTHOR_JUDGE"), type_name=g("TYPE_NAME"), order_date=g("ORDER_DATE"),
        order_date_parsed=dates.balochistan_date(g("ORDER_DATE")),
        pdf_url=R.balochistan_pdf(F.col("FILE_FOLDER"), F.col("FILE_NAME"), F.col("FILE_EXT")),
    )


def shariat_leading(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    staged = df.withColumn("title", g("title")).filter(F.col("title") != "")
    staged = staged.withColumn("__number", R.shariat_number(F.col("title"))).withColumn(
        "__date", R.shariat_title_date(F.col("title"))
    )
    rest = strip(F.replace(F.col("title"), F.col("__number"), F.lit("")), " -–—().,")
    return _build(
        staged, keep, serial=R.serial(g("serial")), case_number=F.col("__number"),
        case_title=F.when(rest != "", rest).otherwise(F.col("title")),
        case_type=courts.shariat_case_type(F.col("__number")), decision_date=F.col("__date"),
        decision_date_parsed=dates.shariat_date(F.col("__date")), pdf_url=R.shariat_pdf(g("pdf_url")),
    )


def shariat_search(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    g = _reader(df)
    staged = df.filter((g("case_number") != "") | (g("title") != ""))
    number = F.when(g("case_number") != "", g("case_number")).otherwise(R.shariat_number(g("title")))
    staged = staged.withColumn("__number", number)
    return _build(
        staged, keep, serial=R.serial(g("serial")), case_number=F.col("__number"), case_title=g("title"),
        case_type=courts.shariat_case_type(F.col("__number")), decision_date=g("decision_date"),
        decision_date_parsed=dates.shariat_date(g("decision_date")), pdf_url=R.shariat_pdf(g("pdf_url")),
    )


def commonlii_links(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(url, title, year, citation); rows without link or title are left out."""
    g = _reader(df)
    url = R.commonlii_url(g("url"))
    rows = df.filter((g("url") != "") & (g("title") != ""))
    return rows.select(
        *keep, url.alias("url"), g("title").alias("title"),
        first(url, r"/(\d{4})/\d+\.html").try_cast("int").alias("year"),
        first(g("title"), R.COMMONLII_CITATION, 0).alias("citation"),
    )


def commonlii_cases(pages: DataFrame, url: str = "page_url", html: str = "html", heading: str = "h2") -> DataFrame:
    """Case pages → metadata, or an error for pages that carry no case."""
    h = F.col(html)
    raw = first(h, rf"<{heading}\b[^>]*>(.*?)</{heading}\s*>", 1, "is")
    error = (
        F.when(F.length(F.coalesce(h, F.lit(""))) < 100, "empty page")
        .when(courts.is_refused_page(h), "refused page")
        .when(raw.isNull(), "no heading")
    )
    staged = pages.withColumn("error", error).withColumn("__raw", F.regexp_replace(raw, "<[^>]*>", ""))
    staged = staged.withColumn("__title", R.decode_entities(F.when(F.col("error").isNull(), F.col("__raw"))))
    pdf = F.coalesce(
        first(h, r"""<object\b[^>]*\bdata=["']([^"']*\.pdf)["']""", 1, "i"),
        first(h, r"""<a\b[^>]*\bhref=["']([^"']*\.pdf)["']""", 1, "i"),
    )
    staged = staged.withColumn("__pdf", F.when(F.col("error").isNull(), pdf))
    site = first(F.col(url), r"^[a-z]+://[^/?#]+", 0, "i")
    folder = first(F.regexp_replace(F.col(url), "[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    link = (
        F.when(F.col("__pdf").rlike("^[A-Za-z]+://"), F.col("__pdf"))
        .when(F.col("__pdf").startswith("/"), F.concat(site, F.col("__pdf")))
        .otherwise(F.concat(folder, F.col("__pdf")))
    )
    fields = R.title_fields(F.col("__title"))
    keep = [c for c in pages.columns if c != html]
    return staged.select(*keep, *(v.alias(k) for k, v in fields.items()), link.alias("pdf_url"), "error")


# Which record column fills each common column, per court.
COMMON = {
    "SC": ("supreme_court", {"case_title": "title", "date": "decision_date_parsed"}),
    "LHC": ("lahore_high_court", {"date": "decision_date_parsed"}),
    "SHC": ("sindh_high_court", {"case_title": "parties", "date": "order_date_parsed"}),
    "IHC": ("islamabad_high_court", {"date": "decision_date_parsed"}),
    "PHC": ("peshawar_high_court", {"date": "decision_date_parsed"}),
    "BHC": ("balochistan_high_court", {"date": "order_date_parsed"}),
    "FSC": ("federal_shariat_court", {"date": "decision_date_parsed"}),
}


def common_view(records: dict[str, DataFrame]) -> DataFrame:
    """(court_code, court, case_number, case_title, date, pdf_url, source_url) of all courts."""
    views = []
    for code, df in records.items():
        court, renamed = COMMON[code]
        columns = {n: renamed.get(n, n) for n in ("case_number", "case_title", "date", "pdf_url", "source_url")}
        views.append(
            df.select(F.lit(code).alias("court_code"), F.lit(court).alias("court"),
                      *(F.col(source).alias(name) for name, source in columns.items()))
        )
    union = views[0]
    for view in views[1:]:
        union = union.unionByName(view)
    return union
