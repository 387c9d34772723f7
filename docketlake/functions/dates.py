"""Dates as the courts write them. Impossible dates are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import every, first, strip

# Month words and the date forms found in judgments.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
ISO = r"(\d{4})-(\d{2})-(\d{2})"
DAY_MONTH_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(\w+)[,.]?\s+(\d{4})"
MONTH_DAY_YEAR = r"(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?[,.]?\s+(\d{4})"
# The word of MONTH_DAY_YEAR begins where a word does or where the last match ended, so no other start is tried.
MONTH_FIRST = r"(?:(?<!\w)|\G)(\w++)\s+(\d{1,2})(?:st|nd|rd|th)?[,.]?\s+(\d{4})"
NUMERIC = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"


def month_number(word: Column) -> Column:
    pairs = [F.lit(x) for item in MONTHS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date from parts, null when there is no such day."""
    dash = F.lit("-")
    parts = [p.cast("string") for p in (year, month, day)]
    return F.concat(parts[0], dash, parts[1], dash, parts[2]).try_cast("date")


def parse_date(text: Column) -> Column:
    """First date form that applies decides; an impossible ISO date ends the search."""
    t = strip(text)
    iso = first(t, ISO, 0)
    dmy_month = month_number(first(t, DAY_MONTH_YEAR, 2, "i"))
    mdy_month = month_number(first(t, MONTH_DAY_YEAR, 1, "i"))
    numeric = first(t, NUMERIC, 0)
    parts = [first(t, NUMERIC, g) for g in (1, 2, 3)]
    return (
        F.when(iso.isNotNull(), ymd(*(first(t, ISO, g) for g in (1, 2, 3))))
        .when(
            dmy_month.isNotNull(),
            ymd(first(t, DAY_MONTH_YEAR, 3, "i"), dmy_month, first(t, DAY_MONTH_YEAR, 1, "i")),
        )
        .when(
            mdy_month.isNotNull(),
            ymd(first(t, MONTH_DAY_YEAR, 3, "i"), mdy_month, first(t, MONTH_DAY_YEAR, 2, "i")),
        )
        .when(numeric.isNotNull(), ymd(parts[2], parts[1], parts[0]))
    )


def first_date(candidates: list[Column]) -> Column:
    """Date of the first candidate text that holds one; later candidates are not looked for."""
    return F.coalesce(*(F.get(F.transform(F.array(c), parse_date), F.lit(0)) for c in candidates))


def all_dates(text: Column) -> Column:
    """Array of (source, date) for every date in the text, form by form."""
    hits = F.concat(
        every(text, ISO, 0),
        every(text, DAY_MONTH_YEAR, 0, "i"),
        every(text, MONTH_FIRST, 0, "i"),
        every(text, NUMERIC, 0),
    )
    dated = F.transform(hits, lambda h: F.struct(h.alias("source"), parse_date(h).alias("date")))
    return F.filter(dated, lambda d: d["date"].isNotNull())


def _three_parts(raw: Column, separators: str) -> tuple[Column, Column]:
    parts = F.split(strip(raw), separators, -1)
    return parts, F.size(parts) == 3


def _number_at(parts: Column, i: int) -> Column:
    return strip(F.get(parts, F.lit(i))).try_cast("int")


def split_dmy(raw: Column, separators: str) -> Column:
    """Day, month and year between single separators (a regex class)."""
    parts, three = _three_parts(raw, separators)
    return F.when(three, ymd(_padded_year(_number_at(parts, 2)), _number_at(parts, 1), _number_at(parts, 0)))


def _padded_year(year: Column) -> Column:
    return F.lpad(year.cast("string"), 4, "0")


def lahore_date(raw: Column) -> Column:
    return split_dmy(raw, "[-/]")


def peshawar_date(raw: Column) -> Column:
    return split_dmy(raw, "-")


def balochistan_date(raw: Column) -> Column:
    return split_dmy(raw, "/")


def shariat_date(raw: Column) -> Column:
    """Dots, slashes or dashes; two-digit years above 50 belong to the 1900s."""
    parts, three = _three_parts(raw, "[-/.]")
    year = _number_at(parts, 2)
    full = F.when(year >= 100, year).when(year > 50, year + 1900).otherwise(year + 2000)
    return F.when(three, ymd(_padded_year(full), _number_at(parts, 1), _number_at(parts, 0)))


def islamabad_date(raw: Column) -> Column:
    """DD-MON-YYYY; month by its three-letter abbreviation only."""
    parts, three = _three_parts(raw, "-")
    word = F.lower(F.get(parts, F.lit(1)))
    month = F.when(F.length(word) == 3, month_number(word))
    return F.when(three, ymd(_padded_year(_number_at(parts, 2)), month, _number_at(parts, 0)))


def sindh_date(raw: Column) -> Column:
    """DD-MON-YY, then DD-MON-YYYY. Two-digit years from 69 on are 1969-1999."""
    t = F.lower(strip(raw))
    short = r"^(\d{1,2})-([a-z]{3})-(\d{2})$"
    full = r"^(\d{1,2})-([a-z]{3})-(\d{4})$"
    yy = first(t, short, 3).cast("int")
    year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)
    return F.coalesce(
        ymd(year, month_number(first(t, short, 2)), first(t, short, 1)),
        ymd(first(t, full, 3), month_number(first(t, full, 2)), first(t, full, 1)),
    )


def supreme_date(raw: Column) -> Column:
    """Month D, YYYY, then D-M-YYYY, then YYYY-M-D; each matched at the start."""
    t = strip(raw)
    long, dashed, iso = r"^(\w+)\s+(\d{1,2}),?\s+(\d{4})", r"^(\d{1,2})-(\d{1,2})-(\d{4})", r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    word = F.lower(first(t, long, 1))
    month = F.when(word != "sept", month_number(word))
    return F.coalesce(
        ymd(first(t, long, 3), month, first(t, long, 2)),
        ymd(first(t, dashed, 3), first(t, dashed, 2), first(t, dashed, 1)),
        ymd(first(t, iso, 1), first(t, iso, 2), first(t, iso, 3)),
    )
