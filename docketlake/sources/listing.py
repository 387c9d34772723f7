"""Listing pages as a Spark data source: one partition per request, filters pushed.

    spark.dataSource.register(ListingSource)
    spark.read.format("court_listing").options(court="LHC", transport="my.module:get",
        years="2020,2021").load().filter("year = 2021")

``transport`` names a function (request: dict) → (body, has_next). Without a network
a directory of captured pages stands in: ``captures=/path`` reads
COURT/YEAR/PAGE.html, or COURT/YEAR/JUDGE/PAGE.html where judges are asked for one by one
(``judges="3,7"``: a partition per year and judge, each failing alone). Paging stops at the last page or an empty
one; a page that fails is an error row and the next is tried. ``max_pages``, if given,
leaves an error row where it cuts.

``requests="[[2020, \"3\"], [2021, null]]"`` names (year, judge) pairs instead, one partition each; their last
row has page 0 if all of their pages were read. ``approved_only`` asks for approved judgments alone.
"""

from __future__ import annotations

import importlib
import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Requests that may fail one after another before a year is given up, with an error row each.
MAX_FAILURES = 3
# The request defaults of the sites.
START_DATE = "2001-01-01"
SEARCH_MODES = {"case": 1, "court": 2, "judge": 3}


def request_for(options: dict[str, str], year: int | None, page: int, judge: str | None = None) -> dict:
    """What is asked for: only the given criteria, with each site's defaults."""
    court = options["court"]
    request: dict = {"court": court, "page": page}
    if year is not None:
        request["year"] = year
    if judge or options.get("judge"):
        request["judge"] = judge or options["judge"]
    if options.get("approved_only", "").lower() == "true":
        request["approved_only"] = True
    if court == "BHC":
        request["searchBy"] = SEARCH_MODES[options.get("search", "judge")]
        request["sDate"] = options.get("start_date", START_DATE)
        # Without an end date the latest judgments are asked for as well.
        if options.get("end_date"):
            request["eDate"] = options["end_date"]
    if court == "IHC":
        flag = "1" if options.get("kind", "reported") == "reported" else "0"
        request |= {"PAFR": flag, "PLANDMARK": flag}
    return request


class Captures:
    """Transport over a directory COURT/YEAR/PAGE.html ('all' when no year is asked)."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, request: dict, page: int) -> str:
        folder = os.path.join(self.root, request["court"], str(request.get("year", "all")))
        own = os.path.join(folder, str(request.get("judge", "")))
        folder = own if request.get("judge_alone") else folder
        return os.path.join(folder, "approved" if request.get("approved_only") else "", f"{page}.html")

    def __call__(self, request: dict) -> tuple[str, bool]:
        with open(self._path(request, request["page"]), encoding="utf-8") as file:
            body = file.read()
        return body, os.path.exists(self._path(request, request["page"] + 1))


class _Request(InputPartition):
    def __init__(self, year: int | None, judge: str | None = None):
        self.year, self.judge = year, judge


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        years = options.get("years", "")
        self.years: list[int | None] = [int(y) for y in years.split(",") if y] or [None]
        self.judges: list[str | None] = [j.strip() for j in options.get("judges", "").split(",") if j.strip()] or [None]
        self.pairs = [(y, j) for y, j in json.loads(options["requests"])] if options.get("requests") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else ()
            if isinstance(f, EqualTo | In) and f.attribute == ("year",):
                self.years = [y for y in self.years if y in wanted]
                self.pairs = self.pairs and [p for p in self.pairs if p[0] in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        pairs = [(y, j) for y in self.years for j in self.judges] if self.pairs is None else self.pairs
        return [_Request(y, j) for y, j in pairs] or [_Request(-1)]

    def _transport(self):
        if "captures" in self.options:
            return Captures(self.options["captures"])
        module, name = self.options["transport"].split(":")
        return getattr(importlib.import_module(module), name)

    def read(self, partition: _Request) -> Iterator[tuple]:
        if partition.year == -1:
            return
        court, year, judge = self.options["court"], partition.year, partition.judge
        get, failures, whole = self._transport(), 0, True
        most = int(self.options["max_pages"]) if self.options.get("max_pages") else None
        for page in itertools.count(1):
            if most is not None and page > most:
                yield (court, year, page, None, f"max_pages: not read beyond page {most}", judge)
                return
            request = request_for(self.options, year, page, judge)
            if judge:
                request["judge_alone"] = True
            try:
                body, more = get(request)
            except Exception as error:
                yield (court, year, page, None, f"{type(error).__name__}: {error}", judge)
                failures, whole = failures + 1, False
                # A year without a first page has no further ones.
                if page == 1 or failures == MAX_FAILURES:
                    return
                continue
            failures = 0
            if body:
                yield (court, year, page, body, None, judge)
            if not more or not body:
                break
        if self.pairs is not None and whole:
            yield (court, year, 0, None, None, judge)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "court_listing"

    def schema(self) -> str:
        return "court string, year int, page int, html string, error string, judge string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))
