"""Duplicates, keyed unions, lookups and limits per group.

First-wins rules use ``row_number() = 1`` directly above the window: Spark then
keeps only the winning rows of each group before the shuffle, so a key that holds a
third of all rows sends a few rows per input split, not the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.identity import normal_case_number, text_hash


def first_per_group(df: DataFrame, group: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; null is a group of its own."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def first_by_url(df: DataFrame, url: str, order: Sequence[str], without_url: str = "keep") -> DataFrame:
    """First row of each URL. Rows without one are all kept, or all dropped."""
    has_url = F.coalesce(F.col(url), F.lit("")) != ""
    firsts = first_per_group(df.filter(has_url), [url], order)
    return firsts if without_url == "drop" else firsts.unionByName(df.filter(~has_url))


def limit_rows(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows; zero and None mean all."""
    return df.orderBy(*order).limit(n) if n else df


def limit_per_group(df: DataFrame, group: str, order: Sequence[str], n: int | None) -> DataFrame:
    return first_per_group(df, [group], order, n) if n else df


def priority_union(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All preferred rows, then the others whose key is new."""
    return preferred.unionByName(
        other.join(preferred.select(key).distinct(), key, "left_anti"), allowMissingColumns=True
    )


# Tasks that rows without a key may be dealt over.
KEYLESS_SPREAD = 1024


def flag_known(df: DataFrame, known: DataFrame, key: str, flag: str, spread: int = 1) -> DataFrame:
    """Adds ``flag``: whether ``key`` occurs in ``known`` (one column of the same name).

    Known keys are reduced to distinct ones first. Spark broadcasts them when their
    measured size allows and otherwise joins by shuffle, where run-time re-planning
    splits an oversized key. ``spread`` > 1 also deals the rows of every key over
    that many partitions, for sessions where re-planning is off. Rows without a key
    match nothing and are dealt out by their other columns, so they never meet in one task.
    """
    keys = known.select(F.col(key).alias("__key")).filter(F.col(key).isNotNull()).distinct()
    keys = keys.withColumn("__known", F.lit(True)).withColumn("__key_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    row = F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    deal = F.pmod(row, F.when(F.col(key).isNull(), F.lit(KEYLESS_SPREAD)).otherwise(F.lit(spread))).cast("int")
    df = df.withColumn("__salt", deal)
    match = (df[key] == keys["__key"]) & (df["__salt"] == keys["__key_salt"])
    out = df.join(keys, match, "left").withColumn(flag, F.coalesce(F.col("__known"), F.lit(False)))
    return out.drop("__key", "__known", "__salt", "__key_salt")


def flag_duplicates(
    df: DataFrame, known_hashes: DataFrame, known_numbers: DataFrame,
    text: str = "text", number: str = "case_number",
) -> DataFrame:
    """Adds ``exact_duplicate`` (text hash known) and ``case_number_match``.

    ``known_hashes`` has column text_hash, ``known_numbers`` normal_number. Blank
    texts and empty numbers match nothing.
    """
    keyed = df.withColumns(
        {
            "text_hash": text_hash(F.col(text)),
            "normal_number": F.nullif(normal_case_number(F.col(number)), F.lit("")),
        }
    )
    keyed = flag_known(keyed, known_hashes, "text_hash", "exact_duplicate")
    return flag_known(keyed, known_numbers, "normal_number", "case_number_match")


def new_texts(df: DataFrame, known_hashes: DataFrame, order: Sequence[str], text: str = "text") -> DataFrame:
    """First row of every text that is not known yet; blank texts are left out."""
    hashed = df.withColumn("text_hash", text_hash(F.col(text))).filter(F.col("text_hash").isNotNull())
    firsts = first_per_group(hashed, ["text_hash"], order)
    return firsts.join(known_hashes.select("text_hash").distinct(), "text_hash", "left_anti")


def fill_missing(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Fills an empty ``value`` from ``lookup`` (key, value), whose keys are made unique.

    Only rows that lack the value take part in the join.
    """
    empty = F.coalesce(F.col(value), F.lit("")) == ""
    asked = empty & (F.coalesce(F.col(key), F.lit("")) != "")
    found = lookup.groupBy(key).agg(F.min(value).alias("__found"))
    filled = df.filter(asked).join(found, key, "left")
    filled = filled.withColumn(value, F.coalesce(F.col("__found"), F.col(value))).drop("__found")
    return df.filter(~asked).unionByName(filled)


def name_of(key: Column, names: dict[int, str], default: Column) -> Column:
    """Name from a fixed table, no join; ``default`` for other keys."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key.cast("int")), default)
