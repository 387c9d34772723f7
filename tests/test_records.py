"""Listing parsers on small captures of each court."""

import datetime as dt

from docketlake.functions import courts
from docketlake.operators import records as P
from docketlake.sources.html_rows import SCHEMAS, rows_of, scan_rows
from pyspark.sql import functions as F


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def frame(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def test_supreme(spark):
    r = one(P.supreme(frame(spark, title=" Civil Appeal No. 12-K of 2020 and others ", post_url="u", date="December 23, 2024",
                            date_attr="", summary="s" * 600, pdf_url="", source_url="src")))
    assert r["case_number"] == "Civil Appeal No. 12-K of 2020"
    assert r["decision_date_parsed"] == dt.date(2024, 12, 23)
    assert len(r["summary"]) == 500 and r["source_url"] == "src"
    assert P.supreme(frame(spark, title="  ", date="")).count() == 0


def test_lahore(spark):
    r = one(P.lahore(frame(spark, serial="3", case_number=" W.P 1 ", decision_date="05/02/2024", pdf_url="2024LHC1.pdf")))
    assert (r["serial"], r["case_number"]) == (3, "W.P 1")
    assert r["decision_date_parsed"] == dt.date(2024, 2, 5)
    assert r["pdf_url"] == "https://sys.lhc.gov.pk/appjudgments/2024LHC1.pdf"


def test_lahore_table_by_position_and_by_header(spark):
    cells = ["1", "C1", "T", "J", "L", "O", "Civil", "01-01-2020", "<a href='/x/a.pdf'>get</a>"]
    rows = [([], cells), ([], cells[:5]), (["Case No", "Judgment"], ["C2", "none"])]
    df = spark.createDataFrame(rows, "headers array<string>, row array<string>")
    got = {r.case_number: r for r in P.lahore_table(df).collect()}
    assert set(got) == {"C1", "C2"}
    assert got["C1"].pdf_url == "https://sys.lhc.gov.pk/x/a.pdf"
    assert got["C2"].pdf_url == "" and got["C2"].serial == 0
    assert [r.category for r in P.by_category(P.lahore_table(df), "CIVIL").collect()] == ["Civil"]


def test_sindh(spark):
    df = frame(spark, serial="x", case_number="C.P  D-1\n /2020", order_date="15-MAY-23", pdf_url="public/f.php?a=1")
    r = one(P.sindh(df.withColumns({"judge_id": F.lit(7), "judge_name": F.lit("N")})))
    assert r["case_number"] == "C.P D-1 /2020" and r["serial"] == 0
    assert r["pdf_url"] == "https://caselaw.shc.gov.pk/caselaw/public/f.php?a=1"
    assert r["order_date_parsed"] == dt.date(2023, 5, 15)


def test_sindh_judges(spark):
    df = spark.createDataFrame(
        [("/x/844/-1", " A ", "1,234", "n/a"), ("/x/none", "B", "1", "1")],
        "total_url string, judge_name string, total string, afr string",
    )
    r = one(P.sindh_judges(df))
    assert (r["judge_id"], r["judge_name"], r["total"], r["afr"]) == (844, "A", 1234, 0)


def test_islamabad(spark):
    good = r'{"d": "[{\"O_ID\": 5, \"CASENO\": \" W.P-1 \", \"DDATE\": \"28-JAN-2026\", \"O_AFR\": 1, \"O_CITATION\": \"-\", \"O_REMARKS\": \"a\\r\\nb\", \"ATTACHMENTS\": \"/att/7/a (b)[1].pdf\", \"O_SC_ATTACHMENTS\": \"-\"}]"}'
    df = spark.createDataFrame([(good,), (r'{"d": "\"empty\""}',), (r'{"d": "empty"}',), ("nope",), (r'{"d": "{}"}',)], "body string")
    rows = P.islamabad_api(df.withColumn("judgment_type", F.lit("reported")))
    errors = sorted(r.api_error for r in rows.filter("api_error is not null").collect())
    assert errors == ["invalid JSON response", "unexpected inner JSON"]
    r = one(P.islamabad(rows.filter("api_error is null")))
    assert r["o_id"] == 5 and r["case_number"] == "W.P-1" and r["citation"] == "" and r["remarks"] == "a b"
    assert r["is_approved_for_reporting"] and not r["is_landmark"]
    assert r["decision_date_parsed"] == dt.date(2026, 1, 28)
    assert r["pdf_url"] == "https://mis.ihc.gov.pk/att/7/a%20%28b%29%5B1%5D.pdf" and r["sc_pdf_url"] == ""


def test_peshawar(spark):
    r = one(P.peshawar(frame(spark, case="W.P No. 1395-M of 2019 A Shah Vs B", decision_date="31-02-2020")))
    assert (r["case_number"], r["case_title"]) == ("W.P No. 1395-M of 2019", "A Shah Vs B")
    assert r["decision_date_parsed"] is None


def test_balochistan(spark):
    page = """<p>x</p><div id="bhc-api-result" style="display:none">{"records": [{"FILE_ID": 9, "CASE_ID": 100107804897,
      "FILE_FOLDER": "2020", "FILE_NAME": "f", "FILE_EXT": "doc", "CASE_TITLE": "A&amp;nbsp;B ", "ORDER_DATE": "02/03/2020"}],
      "courts": [{"COURT_ID": 1, "COURT_TYPE": "21"}, {"COURT_ID": 2, "COURT_TYPE": "30"}],
      "judges": [{"JUDGE_ID": 1, "TOTAL_ORDERS": "0"}, {"JUDGE_ID": 2, "TOTAL_ORDERS": "3"}]}</div>"""
    bad = '<div id="bhc-api-result">{oops</div>'
    df = P.embedded_json(spark.createDataFrame([(page.replace("&amp;nbsp;", "&nbsp;"),), (bad,), ("<p/>",)], "html string"))
    assert sorted(str(r.api_error) for r in df.collect()) == ["None", "invalid result JSON", "no result element"]
    good = df.filter("api_error is null")
    r = one(P.balochistan(good.select(F.inline("api.records"))))
    assert r["case_id"] == 100107804897 and r["case_title"] == "A\xa0B"
    assert r["pdf_url"] == "https://api.bhc.gov.pk/v2/downloadpdf/2020/f.doc"
    assert r["order_date_parsed"] == dt.date(2020, 3, 2)
    assert [x.COURT_ID for x in P.bench_courts(good).collect()] == [1]
    assert [x.JUDGE_ID for x in P.active_judges(good).collect()] == [2]


def test_shariat(spark):
    r = one(P.shariat_leading(frame(spark, serial="1", title="Shariat Petition No. 10-I of 2023 (A v. B) dated 19.03.25", pdf_url="Judgments/a.pdf")))
    assert r["case_number"] == "Shariat Petition No. 10-I of 2023"
    assert r["case_title"] == "A v. B) dated 19.03.25"
    assert r["decision_date_parsed"] == dt.date(2025, 3, 19)
    assert r["pdf_url"] == "https://www.federalshariatcourt.gov.pk/Judgments/a.pdf"
    r = one(P.shariat_search(frame(spark, case_number="", title="Jail Criminal Appeal No. 5-L of 1999", decision_date="1/2/51")))
    assert r["case_type"] == "Jail Criminal Appeal" and r["decision_date_parsed"] == dt.date(1951, 2, 1)


def test_shariat_review_abbreviation_is_other(spark):
    numbers = ["R.Sr.P No. 1 of 2020", "Review Shariat Petition No. 1", "Cr.Rev.No.2", "nothing"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in df.select(courts.shariat_case_type(F.col("n"))).collect()] == [
        "Other", "Review Shariat Petition", "Criminal Revision", "Other"]


def test_commonlii(spark):
    links = spark.createDataFrame([("2024/312.html", "A v B [2024] PKSC 312"), ("", "x"), ("/pk/y", "t")], "url string, title string")
    got = P.commonlii_links(links).collect()
    assert got[0].url == "https://www.commonlii.org/pk/cases/PKSC/2024/312.html" and got[0].year == 2024
    assert got[0].citation == "[2024] PKSC 312" and got[1].year is None
    filler = "<p>" + "x" * 100 + "</p>"
    case = f'<h2>A &amp; B  v. C [2024] PKSC 242; 2024 SCP 240 (19th July 2024)</h2><object data="242.pdf"></object>{filler}'
    pages = [("https://h.org/pk/2024/242.html", case), ("u", "tiny"), ("u", f"captcha {filler}"), ("u", filler)]
    rows = P.commonlii_cases(spark.createDataFrame(pages, "page_url string, html string")).collect()
    assert [r.error for r in rows] == [None, "empty page", "refused page", "no heading"]
    assert rows[0].title == "A & B v. C [2024] PKSC 242; 2024 SCP 240 (19th July 2024)"
    assert rows[0].case_number == "PKSC-2024-242" and rows[0].alt_citations == ["2024 SCP 240"]
    assert rows[0].date_judgment == "19th July 2024" and rows[0].pdf_url == "https://h.org/pk/2024/242.pdf"


def test_html_scan(spark):
    html = """<div class="post"><h2 class="entry-title"><a href="/p1">First &amp; more</a></h2><time datetime="2024-01-02">x</time>
      <div class="entry-content">text <a href="a.doc">d</a><a href="b.pdf">p</a></div></div>
      <table id="employee_list"><tbody><tr><td>1<td>W.P 1 of 2020 A<td>r<td>o<td>n<td>01-02-2020<td>s<td>Civil<td><a href=x.pdf>g</a><td></tr></tbody></table>"""
    post = rows_of(html, SCHEMAS["SC"])
    assert post == [{"title": "First & more", "post_url": "/p1", "date": "x", "date_attr": "2024-01-02",
                     "summary": "text dp", "pdf_url": "b.pdf"}]
    df = scan_rows(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), SCHEMAS["PHC"])
    r = one(P.peshawar(df, keep=["page"]))
    assert (r["page"], r["case_number"], r["category"], r["pdf_url"]) == (1, "W.P 1 of 2020", "Civil", "x.pdf")


def test_page_tests(spark):
    df = spark.createDataFrame([("x We'll be back SOON", 1), ('<a href="/page/3/">', 2), ("", 1)], "html string, page int")
    got = df.select(courts.is_maintenance_page(F.col("html")), courts.has_next_page(F.col("html"), F.col("page"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]
