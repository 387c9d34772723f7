"""Documents behind links: fetch, check, turn into text. One bad link is one error."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

MIN_CHARS_PER_PAGE = 100


def backoff(attempt: Column, base: float = 1.0, longest: float = 60.0) -> Column:
    """Seconds before try ``attempt`` (from 1), doubling up to ``longest``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(longest))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def fetch(
    df: DataFrame, url: str, factory: Callable[[], Callable[[str], bytes]], tries: int = 3,
    requests_per_second: float | None = None, wait_base: float = 2.0,
) -> DataFrame:
    """Adds ``content`` and ``fetch_error``; rows without a link get neither.

    ``factory`` makes a function url → bytes once per task. A rate limit is shared out
    over the tasks that can run at once, so a host with most of the rows needs no single task.
    """
    schema = StructType([*df.schema.fields, StructField("content", BinaryType()), StructField("fetch_error", StringType())])
    share = requests_per_second and requests_per_second / df.sparkSession.sparkContext.defaultParallelism

    def one(get, link) -> tuple[bytes | None, str | None]:
        for attempt in range(1, tries + 1):
            try:
                return get(link), None
            except Exception as error:
                if attempt == tries:
                    return None, f"{type(error).__name__}: {error}"
                time.sleep(wait_base**attempt)
        return None, "no attempt made"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = factory()
        for batch in batches:
            found = []
            for link in batch[url]:
                if not link:
                    found.append((None, None))
                    continue
                if share:
                    time.sleep(1.0 / share)
                found.append(one(get, link))
            yield batch.assign(content=[c for c, _ in found], fetch_error=[e for _, e in found])

    return df.mapInPandas(run, schema)


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Local or stored documents: (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def plain_text(content: bytes) -> tuple[str, int]:
    """Extractor for captured text files."""
    return content.decode("utf-8", "replace"), 1


def pdf_extractor(module: str) -> Callable[[bytes], tuple[str, int]]:
    """Extractor through an installed PDF library ('fitz' or 'pdfplumber')."""
    if module == "fitz":
        import fitz

        def with_fitz(content: bytes) -> tuple[str, int]:
            with fitz.open(stream=content, filetype="pdf") as doc:
                pages = [page.get_text() for page in doc]
            return "\n\n".join(pages), len(pages)

        return with_fitz
    import io

    import pdfplumber

    def with_plumber(content: bytes) -> tuple[str, int]:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages = [p.extract_text() or "" for p in pdf.pages]
        return "\n\n".join(p for p in pages if p), len(pages)

    return with_plumber


def with_text(
    df: DataFrame, primary: Callable[[bytes], tuple[str, int]], fallback: Callable[[bytes], tuple[str, int]] | None = None,
    content: str = "content",
) -> DataFrame:
    """Adds ``text`` ('' where nothing was read) and ``text_length``.

    The fallback is tried below 100 characters per page; the longer text wins.
    """

    def read(extract, data: bytes) -> tuple[str, int]:
        try:
            return extract(data)
        except Exception:
            return "", 0

    def choose(data) -> str:
        if not data:
            return ""
        text, pages = read(primary, bytes(data))
        if fallback and len(text) / max(pages, 1) < MIN_CHARS_PER_PAGE:
            other, _ = read(fallback, bytes(data))
            text = other if len(other) > len(text) else text
        return text.strip()

    @F.pandas_udf(StringType())
    def extracted(column: pd.Series) -> pd.Series:
        return column.map(choose)

    return df.withColumn("text", extracted(F.col(content))).withColumn("text_length", F.length("text"))
