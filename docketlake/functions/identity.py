"""Hashes, normal forms and point identity. Equal inputs give equal ids anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import is_blank, squash, strip

# Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
POINT_TYPES = ["full_text", "chunk", "tier_c", "reasoning"]


def text_hash(text: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased, whitespace-collapsed text; blank gives null."""
    return F.when(~is_blank(text), F.sha2(squash(F.lower(strip(text))), 256))


def normal_case_number(number: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), "[^A-Za-z0-9]", ""))


def name_uuid(name: Column) -> Column:
    """Version 3 UUID of ``name`` in the URL namespace."""
    digest = F.md5(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_key(court: Column, number: Column, kind: Column, sequence: Column) -> Column:
    return F.concat_ws(":", court, number, kind, sequence.cast("string"))


def parent_key(court: Column, number: Column) -> Column:
    return F.concat_ws(":", court, number)


def key_error(*parts: Column) -> Column:
    """Message when a key part is missing or holds the delimiter, else null."""
    bad = F.lit(False)
    for part in parts:
        bad = bad | part.isNull() | part.contains(":")
    return F.when(bad, "key parts must be present and free of ':'")


def safe_filename(url: Column) -> Column:
    """Last path segment, percent-decoded, other characters as '_', always .pdf."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    name = F.substring_index(F.rtrim(F.coalesce(_unquote(path), path), F.lit("/")), "/", -1)
    name = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def _unquote(path: Column) -> Column:
    # '+' is literal in a path, unlike in a query string.
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def quote_segment(segment: Column) -> Column:
    """Percent-encoded path segment."""
    encoded = F.url_encode(segment)
    for form, path in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded

