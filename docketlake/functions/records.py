"""Field rules of the listing records, per court."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketlake.functions.identity import quote_segment
from docketlake.functions.text import every, first, squash, strip, text_or_empty, try_long
from docketlake.sources import sites

# Case-number, date and link forms of the listings.
SUPREME_NUMBER = (
    r"^((?:Constitution\s+Petition|Civil\s+Appeal|Criminal\s+Appeal|"
    r"Cr(?:iminal)?\.?\s*(?:Appeal|Petition|Review)|"
    r"C(?:ivil)?\.?\s*(?:Appeal|Petition|Review)|"
    r"SMC|HRC|CPLA|CMA|CRP|"
    r"(?:Writ|W)\.?\s*P(?:etition)?|"
    r"(?:Human\s+Rights\s+Case)|"
    r"(?:Suo\s+Motu\s+Case)|"
    r"[A-Z][A-Za-z.]+)\s*"
    r"No\.?\s*\d+[-/]?\w*\s*(?:of|OF)\s*\d{4})"
)
PESHAWAR_CASE = r"^(.+?(?:of|OF)\s+\d{4})\s+(.+)$"
SHARIAT_NUMBERS = [
    (
        r"((?:Cr\.?\s*(?:App|Rev|M)|J\.?Cr\.?A|Sh\.?P|S\.?P|R\.?Sr\.?P|W\.?P|"
        r"Shariat\s+Petition|Criminal\s+(?:Appeal|Revision|Miscellaneous)|"
        r"Jail\s+Criminal\s+Appeal|Review\s+Shariat\s+Petition|"
        r"Writ\s+Petition)"
        r"[.\s]*No\.?\s*[\d]+[\s.\-]*[A-Z]?[\s.\-]*(?:of|OF)\s*\d{4})",
        "i",
    ),
    (r"([\w.\s]+No\.?\s*[\d]+[\s\-]*[\w]*[\s\-]*(?:of|OF)\s*\d{4})", ""),
]
SHARIAT_DATES = [
    (r"(?:dated|decision\s+date[:\s]*)\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", "i"),
    (r"\((\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\)\s*$", ""),
    (r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})", ""),
]
COMMONLII_CITATION = r"\[(\d{4})\]\s+PKSC\s+(\d+)"
COMMONLII_OTHER = r"\b(\d{4}\s+(?:SCP|SCMR|PLD|CLC|PCrLJ|PTD|PLC|CLD|YLR|MLD)\s+\d+)\b"
COMMONLII_DATES = [
    r"\((\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4})\)",
    r"\((\w+\s+\d{1,2},?\s+\d{4})\)",
    r"\((\d{1,2}[-/]\d{1,2}[-/]\d{4})\)",
]
PDF_HREF = r"""href=["']([^"']*\.pdf[^"']*)["']"""
PDF_HREF_EXACT = r"""href=["']([^"']*\.pdf)["']"""


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def count_or_zero(raw: Column) -> Column:
    """Digits with thousands commas; anything else is 0."""
    digits = F.replace(text_or_empty(raw), F.lit(","), F.lit(""))
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), try_long(digits)), F.lit(0).cast("bigint"))


def serial(raw: Column) -> Column:
    return F.coalesce(try_long(text_or_empty(raw)), F.lit(0).cast("bigint"))


def supreme_number(title: Column) -> Column:
    t = strip(title)
    return F.coalesce(strip(first(t, SUPREME_NUMBER, 1, "i")), t)


def peshawar_case(raw: Column) -> tuple[Column, Column]:
    """(number, title); the whole cell is the number where it does not split."""
    t = strip(raw)
    number, title = first(t, PESHAWAR_CASE, 1), first(t, PESHAWAR_CASE, 2)
    return strip(F.coalesce(number, t)), strip(F.coalesce(title, F.lit("")))


def shariat_number(title: Column) -> Column:
    found = F.coalesce(*(first(title, p, 1, flags) for p, flags in SHARIAT_NUMBERS), title)
    return strip(found)


def shariat_title_date(title: Column) -> Column:
    return F.coalesce(*(first(title, p, 1, flags) for p, flags in SHARIAT_DATES), F.lit(""))


def is_absolute(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def lahore_pdf(raw: Column) -> Column:
    url = text_or_empty(raw)
    return (
        F.when(is_absolute(url), url)
        .when(url.startswith("/"), F.concat(F.lit(sites.LAHORE_HOST), url))
        .when(url.endswith(".pdf"), F.concat(F.lit(sites.LAHORE_PDF_BASE + "/"), url))
        .otherwise(url)
    )


def lahore_pdf_of_cell(html: Column) -> Column:
    return F.coalesce(lahore_pdf(first(html, PDF_HREF, 1, "i")), F.lit(""))


def resolve(base: str, raw: Column) -> Column:
    """Absolute form of a link: '/x' replaces the path of ``base``, 'x' extends it."""
    url = text_or_empty(raw)
    scheme_host = "/".join(base.split("/")[:3])
    return (
        F.when((url == "") | url.startswith("http"), url)
        .when(url.startswith("//"), F.concat(F.lit(base.split("/")[0]), url))
        .when(url.startswith("/"), F.concat(F.lit(scheme_host), url))
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), url))
    )


def sindh_pdf(raw: Column) -> Column:
    return resolve(sites.SINDH_BASE, raw)


def islamabad_pdf(path: Column) -> Column:
    """Only the file name is percent-encoded; '-' and '' mean none."""
    p = F.coalesce(path, F.lit(""))
    name = F.substring_index(p, "/", -1)
    folder = F.substring(p, F.lit(1), F.length(p) - F.length(name))
    url = F.concat(F.lit(sites.ISLAMABAD_BASE), folder, quote_segment(name))
    return F.when(p.isin("", "-"), "").otherwise(url)


def islamabad_text(raw: Column) -> Column:
    t = F.coalesce(raw, F.lit(""))
    flat = F.replace(F.replace(strip(t), F.lit("\r\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.when(t.isin("", "-"), "").otherwise(flat)


def balochistan_pdf(folder: Column, name: Column, extension: Column) -> Column:
    f, n = F.coalesce(folder, F.lit("")), F.coalesce(name, F.lit(""))
    url = F.concat(
        F.lit(sites.BALOCHISTAN_API + "/v2/downloadpdf/"), f, F.lit("/"), n, F.lit("."),
        F.coalesce(extension, F.lit("")),
    )
    return F.when((f == "") | (n == ""), "").otherwise(url)


def shariat_pdf(raw: Column) -> Column:
    url = text_or_empty(raw)
    base = F.lit(sites.SHARIAT_BASE)
    return (
        F.when((url == "") | url.startswith("http"), url)
        .when(url.startswith("/"), F.concat(base, url))
        .otherwise(F.concat(base, F.lit("/"), url))
    )


def supreme_post_pdf(html: Column) -> Column:
    """First PDF link of a post page, made absolute; '' when there is none."""
    link = F.coalesce(first(html, PDF_HREF_EXACT, 1, "i"), F.lit(""))
    return F.when(link.startswith("/"), F.concat(F.lit(sites.SUPREME_BASE), link)).otherwise(link)


def commonlii_url(raw: Column) -> Column:
    url = strip(raw)
    return (
        F.when(url.startswith("/"), F.concat(F.lit(sites.COMMONLII_BASE), url))
        .when(url.startswith("http"), url)
        .otherwise(F.concat(F.lit(f"{sites.COMMONLII_BASE}{sites.COMMONLII_CASES}/"), url))
    )


def title_fields(title: Column) -> dict[str, Column]:
    """Fields of a case heading whose entities are already decoded."""
    t = squash(strip(title))
    year, number = first(t, COMMONLII_CITATION, 1), first(t, COMMONLII_CITATION, 2)
    return {
        "title": t,
        "citation": first(t, COMMONLII_CITATION, 0),
        "alt_citations": every(t, COMMONLII_OTHER, 1),
        "date_judgment": F.coalesce(*(first(t, p) for p in COMMONLII_DATES)),
        "year": year.try_cast("int"),
        "case_number": F.concat(F.lit("PKSC-"), year, F.lit("-"), number),
    }
