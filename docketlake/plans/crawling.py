"""Crawls that can stop and go on: requests from a judges table, stored pages as the ledger, texts.

A request is a (court, year, judge). Pages are stored wave by wave, each wave one Spark write:
what is stored is whole, what is not is asked again. A request's last row, page 0, says that
it was read to its end, so the stored pages are the ledger, and an anti-join finds what is left.
A request that fails keeps its error rows and is tried again by the next run, alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.operators.dedup import first_per_group
from docketlake.sources.fetch import fetch, is_pdf, plain_text, read_binaries, with_text
from docketlake.sources.listing import ListingSource
from docketlake.staging import scratch

#: Requests of one wave: what a stopped run loses at most.
WAVE = 256
STORED = "court string, year int, page int, html string, error string, judge string, run int, wave string"
_SAME = ["court", "year", "judge"]


def requests(spark: SparkSession, court: str, years: Sequence[int] = (), judges: DataFrame | None = None, judge: str = "judge_id") -> DataFrame:
    """(court, year, judge): every year of every judge; null years ask for all, null judges for everyone at once.

    Judges come from a table, such as ``sindh_judges``, ``islamabad_judges`` or ``balochistan_judges``.
    """
    asked = judges.select(F.col(judge).cast("string").alias("judge")).filter("judge IS NOT NULL").distinct() if judges is not None else spark.range(1).select(F.lit(None).cast("string").alias("judge"))
    every = F.array(*[F.lit(y) for y in years]).cast("array<int>") if years else F.array(F.lit(None).cast("int"))
    return asked.select(F.lit(court).alias("court"), F.explode(every).alias("year"), "judge")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(STORED).parquet(store) if there else spark.createDataFrame([], STORED)


def _without(asked: DataFrame, some: DataFrame) -> DataFrame:
    some = some.select(*[F.col(c).alias(f"__{c}") for c in _SAME]).distinct()
    return asked.join(some, [asked[c].eqNullSafe(F.col(f"__{c}")) for c in _SAME], "left_anti")


def left_over(spark: SparkSession, asked: DataFrame, store: str) -> DataFrame:
    """The requests that were not read to their end."""
    return _without(asked, _stored(spark, store).filter("page = 0"))


def crawl_pages(spark: SparkSession, asked: DataFrame, store: str, wave: int = WAVE, **options: str) -> int:
    """Asks what is left, WAVE requests at a time, and returns how many requests this run made.

    ``options``: those of the listing source (transport or captures, kind, approved_only …).
    The driver holds one wave's requests, never their pages.
    """
    spark.dataSource.register(ListingSource)
    run, made = (_stored(spark, store).agg(F.max("run")).first()[0] or 0) + 1, 0
    while True:
        todo = _without(left_over(spark, asked, store), _stored(spark, store).filter(F.col("run") == run))
        todo = todo.orderBy(*[F.asc_nulls_first(c) for c in _SAME]).limit(wave).collect()
        if not todo:
            return made
        for court in sorted({r["court"] for r in todo}):
            listed = json.dumps([[r["year"], r["judge"]] for r in todo if r["court"] == court])
            pages = spark.read.format("court_listing").options(court=court, requests=listed, **options).load()
            pages.withColumns({"run": F.lit(run), "wave": F.lit(uuid.uuid4().hex)}).write.mode("append").parquet(store)
        made += len(todo)


def stored_pages(spark: SparkSession, store: str) -> DataFrame:
    """Every page once, as the last run that read it found it."""
    found = _stored(spark, store).filter("html IS NOT NULL")
    return first_per_group(found, [*_SAME, "page"], [F.desc("run"), "wave"]).drop("error", "run", "wave")


def failed_requests(spark: SparkSession, store: str) -> DataFrame:
    """The error rows of the last run of requests that are not finished: none if the crawl is complete."""
    rows = _stored(spark, store)
    last = F.max("run").over(Window.partitionBy(*_SAME))
    done = F.max(F.when(F.col("page") == 0, 1).otherwise(0)).over(Window.partitionBy(*_SAME))
    rows = rows.withColumns({"__last": last, "__done": done}).filter("run = __last AND __done = 0 AND error IS NOT NULL")
    return rows.select(*_SAME, "page", "error")


def _captured(links: DataFrame, folder: str) -> DataFrame:
    """As ``fetch``, from a folder of captured documents, found by the last part of their link."""
    files = read_binaries(links.sparkSession, folder).select(F.element_at(F.split("path", "/"), -1).alias("__name"), "content")
    name = F.element_at(F.split(F.rtrim(F.col("__url"), F.lit("/")), "/"), -1)
    got = links.join(files, name == F.col("__name"), "left").drop("__name")
    return got.withColumn("fetch_error", F.when(F.col("content").isNull(), F.lit("FileNotFoundError: no captured document")))


def with_texts(
    records: DataFrame, where: Callable[[], Callable[[str], bytes]] | str, url: str = "pdf_url", source: str | None = None,
    primary: Callable[[bytes], tuple[str, int]] = plain_text, fallback: Callable[[bytes], tuple[str, int]] | None = None,
    pdf_only: bool = True, **how,
) -> DataFrame:
    """Records with text, text_length, source and error: fetch, check, read, one link at a time.

    ``where``: what makes a task's function url → bytes, or a folder of captured documents. Each
    distinct link is fetched once, by a task that gets links only, and its text is stored before
    it meets its records. A missing link, a failed request and a document that is no PDF
    leave an empty text; the latter two say why.
    """
    links = records.select(F.col(url).alias("__url")).filter("coalesce(__url, '') != ''").distinct()
    got = _captured(links, where) if isinstance(where, str) else fetch(links, "__url", where, **how)
    wrong: Column = F.when(F.col("fetch_error").isNull() & F.lit(pdf_only) & ~is_pdf(F.col("content")), F.lit("not a PDF"))
    got = got.withColumn("error", F.coalesce("fetch_error", wrong))
    got = got.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    path = scratch(records.sparkSession, "texts")
    with_text(got, primary, fallback).select("__url", "text", "text_length", "error").write.parquet(path)
    texts = records.sparkSession.read.parquet(path)
    met = records.drop("text", "text_length", "error").join(texts, F.col(url) == F.col("__url"), "left").drop("__url")
    met = met.withColumns({"text": F.coalesce("text", F.lit("")), "text_length": F.coalesce("text_length", F.lit(0))})
    return met.withColumn("source", F.lit(source)) if source else met
