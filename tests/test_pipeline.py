"""Sources, composed plan, collection and streams on small inputs."""

import json
import os

from docketlake.__main__ import main
from docketlake.operators import points as Pt
from docketlake.operators.passes import Recorded
from docketlake.operators.search import INDEXED_FIELDS, build_filter, format_results, search_hybrid
from docketlake.operators.embedding import embed_query
from docketlake.plans.pipeline import extract, ingest, rejected, to_points
from docketlake.sources import fetch as Ft
from docketlake.sources.listing import ListingSource, request_for
from docketlake.streaming.incremental import start_new_texts
from docketlake.workload import judgments as J
from pyspark.sql import functions as F

ROW = "<tr><td>{n}</td><td>W.P {n} of 2020 A Vs B</td><td>r</td><td>o</td><td>n</td><td>01-02-2020</td><td>s</td><td>{c}</td><td><a href='{u}'>x</a></td><td></td></tr>"


def capture(root, court, year, page, rows):
    folder = root / court / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{page}.html").write_text(f'<table id="employee_list"><tbody>{"".join(rows)}</tbody></table>')


def test_listing_source_and_cli(spark, tmp_path):
    capture(tmp_path, "PHC", 2020, 1, [ROW.format(n=1, c="Civil", u="a.pdf"), ROW.format(n=2, c="Criminal", u="")])
    capture(tmp_path, "PHC", 2020, 2, [ROW.format(n=3, c="civil", u="a.pdf"), ROW.format(n=4, c="Civil", u="")])
    capture(tmp_path, "PHC", 2021, 1, [ROW.format(n=5, c="Civil", u="b.pdf")])
    spark.dataSource.register(ListingSource)
    pages = spark.read.format("court_listing").options(court="PHC", captures=str(tmp_path), years="2020,2021,2022").load()
    assert sorted((r.year, r.page, r.error is None) for r in pages.collect()) == [
        (2020, 1, True), (2020, 2, True), (2021, 1, True), (2022, 1, False)]
    assert pages.filter("year = 2021").count() == 1
    out = str(tmp_path / "out")
    main(["crawl", "--court", "PHC", "--captures", str(tmp_path), "--output", out, "--year", "2020", "2021"])
    rows = spark.read.json(f"{out}/results").collect()
    assert sorted(r.serial for r in rows) == [1, 2, 4, 5]  # the second a.pdf is a repeat
    summary = json.loads(next(open(os.path.join(out, "summary", f)).read() for f in os.listdir(f"{out}/summary") if f.endswith(".json")))
    assert summary["total"] == 4 and summary["with_text"] == 0 and summary["failed_requests"] == 0


def test_each_judge_is_asked_alone(spark, tmp_path):
    capture(tmp_path, "PHC", "2020/3", 1, [ROW.format(n=1, c="Civil", u="a.pdf")])
    capture(tmp_path, "PHC", "2020/3", 2, [ROW.format(n=2, c="Civil", u="b.pdf")])
    capture(tmp_path, "PHC", "2020/9", 1, [ROW.format(n=3, c="Civil", u="c.pdf")])
    out = str(tmp_path / "out")
    main(["crawl", "--court", "PHC", "--captures", str(tmp_path), "--output", out, "--year", "2020", "--judges", "3", "7", "9"])
    assert sorted(r.serial for r in spark.read.json(f"{out}/results").collect()) == [1, 2, 3]
    failed = spark.read.json(f"{out}/phc_failed_requests").collect()
    assert [(r.judge, r.page) for r in failed] == [("7", 1)]
    assert spark.read.json(f"{out}/summary").first().failed_requests == 1


def test_failing_and_cut_pages_leave_error_rows():
    from docketlake.sources.listing import ListingReader, _Request

    reader = ListingReader({"court": "PHC", "captures": "-", "years": "2020"})

    def get(request):
        if request["page"] == 2:
            raise OSError("gone")
        return "x", request["page"] < 250

    reader._transport = lambda: get
    rows = list(reader.read(_Request(2020)))
    assert [r[2] for r in rows] == list(range(1, 251)) and [r[2] for r in rows if r[4]] == [2]
    reader.options["max_pages"] = "3"
    assert [(r[2], r[4] is None) for r in reader.read(_Request(2020))] == [(1, True), (2, False), (3, True), (4, False)]


def test_request_defaults():
    assert request_for({"court": "BHC", "judge": "7"}, None, 1) == {
        "court": "BHC", "page": 1, "judge": "7", "searchBy": 3, "sDate": "2001-01-01"}
    assert request_for({"court": "BHC", "end_date": "2020-01-01"}, None, 1)["eDate"] == "2020-01-01"
    assert request_for({"court": "IHC", "kind": "important"}, 2020, 2)["PAFR"] == "0"


def test_fetch_and_text_choice(spark):
    def factory():
        def get(url):
            if "bad" in url:
                raise OSError("gone")
            return b"%PDF thin"

        return get

    df = spark.createDataFrame([("http://a",), ("http://bad",), ("",)], "url string")
    got = Ft.fetch(df, "url", factory, tries=2, wait_base=0.01)
    got = got.withColumn("pdf", Ft.is_pdf(F.col("content")))
    out = Ft.with_text(got, lambda b: ("x" * 50, 2), lambda b: ("y" * 60, 2)).orderBy("url").collect()
    assert [(r.text[:1], r.text_length, r.fetch_error, r.pdf) for r in out] == [
        ("", 0, None, False), ("y", 60, None, True), ("", 0, "OSError: gone", False)]
    assert [r[0] for r in spark.range(1, 9).select(Ft.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_extract_ingest_search_twice(spark, tmp_path):
    docs = J.judgments(spark, "/root/testdata/sf0.001").filter("judgment_id < 24")
    docs = docs.select("judgment_id", "source_url", "text", F.lit("SC").alias("court"),
                       F.concat(F.lit("J-"), F.col("judgment_id").cast("string")).alias("case_number"))
    answer = json.dumps({"judgment_type": "acquittal", "ratio_decidendi": "No conviction on doubt alone",
                         "points": [{"point_type": "facts", "text": "The facts in short form"}]})
    extracted = extract(docs, lambda: Recorded(default=answer), "source_url")
    meta = extracted.select("extraction_metadata.*").first()
    assert meta.tier_b_error is None and meta.reasoning_point_count == 1 and meta.tier_c_pct == 5.9
    store = str(tmp_path / "points")
    points = to_points(extracted)
    ingest(spark, points, store, 1)
    info = Pt.collection_info(spark, store)
    ingest(spark, points, store, 2)
    assert Pt.collection_info(spark, store) == info and info["points_count"] % 3 == 0
    stored = Pt.read_collection(spark, store)
    # Every judgment is either stored or rejected with a reason.
    bad = rejected(extracted.withColumn("text", F.when(F.col("judgment_id") == 1, "").otherwise(F.col("text")))).collect()
    assert 1 in {r.judgment_id for r in bad} and all(r.reject_reason for r in bad)
    left = {r.judgment_id for r in rejected(extracted).collect()}
    assert len(left) + stored.select("parent_case_id").distinct().count() == docs.count()
    assert stored.agg(F.min("version")).first()[0] == 2
    where = build_filter(stored, point_type=["full_text", "chunk"], ppc_sections=302)
    found = search_hybrid(stored, "section 302 PPC appeal", embed_query("section 302 PPC appeal"), 5, where)
    assert set(INDEXED_FIELDS) <= set(stored.columns)
    hits = format_results(found).collect()
    assert hits and all(h.id and h.case_number and h.judgment_type == "acquittal" for h in hits)
    assert stored.filter(build_filter(stored, offense_category="state", sentence_type=["life"])).count() == 0
    kept = {r.point_uuid for r in stored.filter("array_contains(ppc_sections, 302)").collect()}
    assert {h.id for h in hits} <= kept
    assert search_hybrid(stored, "1 2", embed_query("x"), 3).count() == 3
    assert Pt.delete_collection(spark, store) and Pt.collection_info(spark, store) == {"exists": False}


def test_rejects(spark):
    df = spark.createDataFrame([("t", "SC", "1"), (" ", "SC", "2"), ("t", "SC", ""), ("t", "SC", "a:b")], "text string, court string, case_number string")
    good, bad = Pt.split_rejects(df)
    assert good.count() == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["empty text", "key parts must be present and free of ':'", "no case number"]


def test_stream_keeps_first_of_each_text(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, text string"

    def load(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        start_new_texts(stream, out, str(tmp_path / "cp"), "id").awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert load([(1, "A  b"), (2, "a B"), (3, "c"), (4, " ")]) == [1, 3]
    assert load([(5, "C"), (6, "d")]) == [1, 3, 6]
