"""Crawls over a judges table: stopped and resumed runs, failing requests, texts."""

import json

import pytest
from pyspark.sql import functions as F

from docketlake.__main__ import main
from docketlake.operators import records as P
from docketlake.plans import crawling as C
from test_pipeline import ROW, capture


def judges(spark, *ids):
    return spark.createDataFrame([(i, f"J {i}") for i in ids], "judge_id long, judge_name string")


def pages(spark, store):
    return sorted((r.year, r.judge, r.page, r.html) for r in C.stored_pages(spark, store).collect())


@pytest.fixture
def captured(tmp_path):
    for year, judge, count in ((2020, 3, 2), (2020, 9, 1), (2021, 3, 1), (2021, 9, 3)):
        for page in range(1, count + 1):
            capture(tmp_path / "in", "PHC", f"{year}/{judge}", page, [ROW.format(n=100 * judge + page, c="Civil", u=f"{year}{judge}{page}.pdf")])
    return tmp_path


def test_a_stopped_run_goes_on_where_it_stopped(spark, captured, monkeypatch):
    root, one, two = str(captured / "in"), str(captured / "one"), str(captured / "two")
    asked = C.requests(spark, "PHC", [2020, 2021], judges(spark, 3, 9, 9))
    assert asked.count() == 4 and C.crawl_pages(spark, asked, one, captures=root) == 4
    made, real = [], C.uuid.uuid4

    def dying():
        made.append(1)
        if len(made) == 3:
            raise KeyboardInterrupt
        return real()

    with monkeypatch.context() as stopped:
        stopped.setattr(C.uuid, "uuid4", dying)
        with pytest.raises(KeyboardInterrupt):
            C.crawl_pages(spark, asked, two, wave=1, captures=root)
    assert C.left_over(spark, asked, two).count() == 2
    assert C.crawl_pages(spark, asked, two, captures=root) == 2 and C.crawl_pages(spark, asked, two, captures=root) == 0
    assert pages(spark, two) == pages(spark, one) and len(pages(spark, one)) == 7


def test_one_failing_judge_leaves_the_others(spark, captured):
    root, store = str(captured / "in"), str(captured / "store")
    asked = C.requests(spark, "PHC", [2020], judges(spark, 3, 7, 9))
    assert C.crawl_pages(spark, asked, store, wave=2, captures=root) == 3
    assert [(r.judge, r.page) for r in C.failed_requests(spark, store).collect()] == [("7", 1)] and len(pages(spark, store)) == 3
    capture(captured / "in", "PHC", "2020/7", 1, [ROW.format(n=7, c="Civil", u="late.pdf")])
    assert C.crawl_pages(spark, asked, store, captures=root) == 1
    assert C.failed_requests(spark, store).count() == 0 and len(pages(spark, store)) == 4


def test_requests_without_years_or_judges(spark):
    assert [tuple(r) for r in C.requests(spark, "SC").collect()] == [("SC", None, None)]
    assert sorted(tuple(r) for r in C.requests(spark, "LHC", [2020, 2021]).collect()) == [("LHC", 2020, None), ("LHC", 2021, None)]


def test_judges_of_an_api(spark):
    inner = json.dumps([{"JUDGE_ID": 5, "JUG_REALNAME": " A B ", "ISRETIRED": 1}, {"JUDGE_ID": None, "JUG_REALNAME": "x"}, {"JUDGE_ID": 6}])
    df = spark.createDataFrame([(json.dumps({"d": inner}),), (json.dumps({"d": '"empty"'}),), ("no json",)], "body string")
    assert sorted(map(tuple, P.islamabad_judges(df).collect())) == [(5, "A B", True), (6, "Unknown", False)]


def test_texts_are_fetched_once_checked_and_read(spark):
    def factory():
        def get(url):
            if url == "gone":
                raise OSError("404")
            return b"%PDF text of " + url.encode() if url.endswith(".pdf") else b"<html>"

        return get

    rows = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "page"), (4, "gone"), (5, ""), (6, None)], "id int, pdf_url string")
    got = C.with_texts(rows, factory, source="phc", tries=1).orderBy("id").collect()
    assert [(r.text, r.error, r.source) for r in got] == [
        ("%PDF text of a.pdf", None, "phc")] * 2 + [("", "not a PDF", "phc"), ("", "OSError: 404", "phc"), ("", None, "phc"), ("", None, "phc")]
    assert [r.text_length for r in got] == [18, 18, 0, 0, 0, 0]


def test_command_line_resumes_and_reads_documents(spark, captured):
    root, out, documents = captured / "in", str(captured / "out"), captured / "pdfs"
    documents.mkdir()
    (documents / "202031.pdf").write_bytes(b"%PDF the judgment")
    listed = captured / "judges.json"
    listed.write_text("\n".join(json.dumps({"judge_id": i}) for i in (3, 9)))
    args = ["crawl", "--court", "PHC", "--captures", str(root), "--output", out, "--year", "2020", "2021", "--judges-table", str(listed), "--resume", "--documents", str(documents)]
    for _ in range(2):
        main(args)
        rows = spark.read.json(f"{out}/results").collect()
        texts = {r.text for r in rows if r.text}
        assert len(rows) == 7 and texts == {"%PDF the judgment"}
        assert {r.error for r in rows if not r.text} == {"FileNotFoundError: no captured document"}
    summary = spark.read.json(f"{out}/summary").first()
    assert (summary.total, summary.with_text, summary.failed_requests) == (7, 1, 0)
