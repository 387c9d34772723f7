"""Model answers (JSON) into typed columns. Values keep their JSON type until coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import first, strip

# Strings that mean "missing", and words for true.
NULL_WORDS = ["null", "none", "n/a", ""]
TRUE_WORDS = ["true", "yes", "1"]
FENCE = r"```(?:json)?\s*\n?(.*?)```"


def without_fence(answer: Column) -> Column:
    """Content of a markdown code fence, or the answer as it is."""
    return F.coalesce(first(answer, FENCE, 1, "s"), answer)


def kind(value: Column) -> Column:
    """BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, ARRAY, OBJECT, VOID; null for SQL null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_number(value: Column) -> Column:
    return kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def as_text(value: Column) -> Column:
    text = value.try_cast("string")
    return F.when(kind(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def flat_entries(answer: Column) -> Column:
    """Array of (key, value) with groups dissolved one level deep.

    Later entries win; grouped keys come after top-level ones.
    """
    top = F.map_entries(F.from_json(answer, "map<string,variant>"))
    plain = F.filter(top, lambda e: F.coalesce(kind(e["value"]) != "OBJECT", F.lit(True)))
    groups = F.filter(top, lambda e: kind(e["value"]) == "OBJECT")
    inner = F.flatten(
        F.transform(groups, lambda e: F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")))
    )
    return F.concat(plain, inner)


def value_of(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def is_missing_text(text: Column) -> Column:
    return F.lower(strip(text)).isin(NULL_WORDS)


def present(value: Column) -> Column:
    """Null for JSON null and for strings that mean missing."""
    missing = (kind(value) == "VOID") | ((kind(value) == "STRING") & is_missing_text(value.try_cast("string")))
    return F.when(~missing, value)


def elements(value: Column) -> Column:
    return F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def to_strings(value: Column) -> Column:
    """List without missing elements; a single string is a list of one."""
    items = F.transform(F.filter(elements(value), lambda v: present(v).isNotNull()), as_text)
    one = F.when(kind(value) == "STRING", F.array(value.try_cast("string")))
    return F.coalesce(items, one, F.array().cast("array<string>"))


def to_bool(value: Column) -> Column:
    words = F.lower(value.try_cast("string")).isin(TRUE_WORDS)
    return F.when(kind(value) == "BOOLEAN", value.try_cast("boolean")).when(kind(value) == "STRING", words)


def to_long(value: Column) -> Column:
    """Numbers lose their fraction; strings must be whole numbers; true counts as 1."""
    text = strip(value.try_cast("string"))
    return (
        F.when(is_number(value), value.try_cast("double").cast("bigint"))
        .when(kind(value) == "BOOLEAN", value.try_cast("boolean").cast("bigint"))
        .when((kind(value) == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    )


def to_string(value: Column) -> Column:
    """Text of any value; 0, false and empty lists count as missing."""
    empty = as_text(value).isin("0", "0.0", "False", "[]", "{}")
    return F.when((kind(value) == "STRING") | ~empty, as_text(value))


def safe_text(value: Column) -> Column:
    text = strip(as_text(F.when(kind(value) != "VOID", value)))
    return F.when(text != "", text)


def safe_texts(value: Column) -> Column:
    # Numbers that are 0, false and empty lists are missing items, as elsewhere.
    texts = F.transform(elements(value), lambda x: F.when(to_string(x).isNotNull(), safe_text(x)))
    return F.coalesce(F.array_compact(texts), F.array().cast("array<string>"))


def safe_longs(value: Column) -> Column:
    return F.coalesce(F.array_compact(F.transform(elements(value), to_long)), F.array().cast("array<bigint>"))


def safe_share(value: Column, default: float = 0.5) -> Column:
    """Number or numeric string clamped to [0, 1]; the default for anything else."""
    usable = is_number(value) | (kind(value) == "STRING")
    number = F.when(usable, value.try_cast("string").try_cast("double"))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    return F.when(number.isNotNull(), clamped).otherwise(F.lit(default))
