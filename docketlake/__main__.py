"""python -m docketlake crawl --court LHC --captures DIR --output DIR [--year Y …]"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from docketlake.plans import crawling
from docketlake.plans.pipeline import COURTS, crawl, write_run
from docketlake.session import local_session
from docketlake.sources.listing import ListingSource


def resumable(spark, args, store: str):
    """(pages, failed requests) of a crawl that goes on with what is stored."""
    judges = None
    if args.judges_table:
        judges = spark.read.format("parquet" if args.judges_table.endswith(".parquet") else "json").load(args.judges_table)
    elif args.judges:
        judges = spark.createDataFrame([(j,) for j in args.judges], "judge_id string")
    asked = crawling.requests(spark, args.court, args.year, judges)
    options = {"approved_only": "true"} if args.approved_only else {}
    crawling.crawl_pages(spark, asked, store, captures=args.captures, **options)
    return crawling.stored_pages(spark, store), crawling.failed_requests(spark, store)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docketlake")
    parser.add_argument("command", choices=["crawl"])
    parser.add_argument("--court", choices=sorted(COURTS), required=True)
    parser.add_argument("--captures", required=True, help="directory COURT/YEAR/PAGE.html")
    parser.add_argument("--output", required=True)
    parser.add_argument("--year", type=int, nargs="*", default=[])
    parser.add_argument("--judge-id", type=int, default=None)
    parser.add_argument("--judges", nargs="*", default=[], help="ask judge by judge; captures lie in COURT/YEAR/JUDGE")
    parser.add_argument("--judge-name", default=None)
    parser.add_argument("--category", default=None)
    parser.add_argument("--judges-table", default=None, help="JSON lines or Parquet with judge_id: asks every judge of the table, resumably")
    parser.add_argument("--approved-only", action="store_true", help="ask for judgments approved for reporting alone")
    parser.add_argument("--resume", action="store_true", help="go on with the pages stored in --output")
    parser.add_argument("--documents", default=None, help="directory of captured documents, named as the links' last part")
    parser.add_argument("--limit", type=int, default=None)
    parser.add_argument("--limit-per-year", type=int, default=None)
    args = parser.parse_args(argv)

    spark = local_session()
    spark.dataSource.register(ListingSource)
    options = {"court": args.court, "captures": args.captures, "years": ",".join(map(str, args.year))}
    if args.judges:
        options["judges"] = ",".join(args.judges)
    if args.approved_only:
        options["approved_only"] = "true"
    # Pages are stored first, so that each request is made once.
    store = f"{args.output}/{args.court.lower()}_pages"
    if args.resume or args.judges_table:
        pages, failed = resumable(spark, args, store)
    else:
        asked = spark.read.format("court_listing").options(**options).load()
        asked.write.mode("overwrite").parquet(store)
        pages = spark.read.schema(asked.schema).parquet(store)
        failed = pages.filter("html is null").select("court", "year", "judge", "page", "error")
    # Requests that failed are part of the result: a run is complete only if this table is empty.
    failed.write.mode("overwrite").json(f"{args.output}/{args.court.lower()}_failed_requests")
    pages = pages.filter("html is not null").withColumns(
        {"judge_id": F.coalesce(F.lit(args.judge_id), F.expr("try_cast(judge AS INT)")),
         "judge_name": F.coalesce(F.lit(args.judge_name), F.concat(F.lit("Judge "), F.coalesce(F.lit(args.judge_id).cast("string"), "judge")))}
    ).drop("judge")
    found = crawl(pages, args.court, args.limit, args.category, args.limit_per_year)
    source, url = args.court.lower(), "url" if args.court == "COMMONLII" else "pdf_url"
    if args.documents:
        results = crawling.with_texts(found, args.documents, url, source)
    else:  # texts come from captured documents or, in a job of one's own, from a transport
        results = found.withColumns({"text": F.lit(""), "text_length": F.lit(0), "error": F.lit(None).cast("string"), "source": F.lit(source)})
    write_run(results, args.output, args.court, failed)


if __name__ == "__main__":
    main()
