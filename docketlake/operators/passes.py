"""Model passes: request texts, answers through a provider, answers into columns.

The provider is any object with ``complete(prompt) -> str``; it is created once per
task by a factory, so connections live where the rows are. ``Recorded`` replays
stored answers and makes every result reproducible without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docketlake.functions import model_json as M
from docketlake.functions.text import strip
from docketlake.operators.layouts import POINT_TYPES, TIER_B, TIER_C, VOCABULARIES


class Refused(Exception):
    """The provider declined; asking again would not help."""


class Misconfigured(Exception):
    """The provider cannot be used; asking again would not help."""


class Recorded:
    """Answers from a dictionary of prompt → answer; the default for other prompts."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "{}"):
        self.answers, self.default = answers or {}, default

    def complete(self, prompt: str) -> str:
        return self.answers.get(prompt, self.default)


def ask(
    df: DataFrame, prompt: str, factory: Callable[[], object], into: str = "answer",
    tries: int = 3, wait_base: float = 2.0,
) -> DataFrame:
    """Adds ``into`` and ``into``_error. Other failures are tried again after 2, 4 … seconds.

    A null prompt is not sent. Failures become error rows and never end the job.
    """
    def one(provider, text) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        for attempt in range(1, tries + 1):
            try:
                return provider.complete(text), None
            except Refused as error:
                return None, f"content_refused: {error}"
            except Misconfigured as error:
                return None, f"llm_error: {error}"
            except Exception as error:
                if attempt == tries:
                    return None, f"failed after {tries} attempts: {error}"
                time.sleep(wait_base**attempt)
        return None, "no attempt made"

    # Only the prompt travels to Python; the other columns stay where they are. Not
    # deterministic: Spark must never copy the call into a second place.
    @F.pandas_udf(StructType([StructField("answer", StringType()), StructField("error", StringType())]))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            yield pd.DataFrame([one(provider, text) for text in batch], columns=["answer", "error"])

    answered = df.withColumn("__call", call.asNondeterministic()(F.col(prompt)))
    return answered.withColumns({into: F.col("__call.answer"), f"{into}_error": F.col("__call.error")}).drop("__call")


def parse_tier_b(
    df: DataFrame, answer: str = "answer", into: str = "tier_b", keep_none: bool = False,
    fields: tuple[str, ...] = tuple(TIER_B),
) -> DataFrame:
    """Adds struct ``into`` (92 fields unless fewer are named) and ``into``_rejects.

    Values outside a vocabulary become null and are named in the rejects. With
    ``keep_none`` the word "none" is kept where a vocabulary lists it.
    """
    entries = M.flat_entries(M.without_fence(F.col(answer)))
    staged = df.withColumn("__entries", F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")))
    columns, rejects = [], []
    for field in fields:
        kind = TIER_B[field]
        raw = M.value_of(F.col("__entries"), field)
        value = M.present(raw)
        if kind == "array<string>":
            columns.append(M.to_strings(value).alias(field))
        elif kind == "boolean":
            columns.append(M.to_bool(value).alias(field))
        elif kind == "bigint":
            columns.append(M.to_long(value).alias(field))
        elif field in VOCABULARIES:
            allowed = VOCABULARIES[field]
            text = M.to_string(value)
            if keep_none and "none" in allowed:
                text = F.coalesce(text, F.when(F.lower(raw.try_cast("string")) == "none", "none"))
            columns.append(F.when(text.isin(allowed), text).alias(field))
            rejects.append(F.when(~text.isin(allowed), F.concat(F.lit(f"{field}="), text)))
        else:
            columns.append(M.to_string(value).alias(field))
    staged = staged.withColumns({into: F.struct(*columns), f"{into}_rejects": F.array_compact(F.array(*rejects))})
    return staged.drop("__entries")


def parse_tier_c(df: DataFrame, answer: str = "answer", into: str = "tier_c") -> DataFrame:
    """Adds struct ``into`` of 17 passages: trimmed strings above five characters."""
    entries = M.flat_entries(M.without_fence(F.col(answer)))
    staged = df.withColumn("__entries", F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")))

    def passage(field: str) -> Column:
        value = M.value_of(F.col("__entries"), field)
        text = F.when(M.kind(value) == "STRING", strip(value.try_cast("string")))
        return F.when(F.length(text) > 5, text).alias(field)

    return staged.withColumn(into, F.struct(*(passage(f) for f in TIER_C))).drop("__entries")


def parse_points(df: DataFrame, answer: str = "answer", into: str = "points") -> DataFrame:
    """Adds array ``into`` of valid reasoning points, total_issues, counts and an error.

    Points need a known type and ten characters of text; the valid ones are numbered
    from 0. Struct ``into``_meta: raw_count, valid_count, skipped_count, error.
    """
    body = F.try_parse_json(M.without_fence(F.col(answer)))
    staged = df.withColumn("__json", body)
    is_object = M.kind(F.col("__json")) == "OBJECT"
    raw = F.try_variant_get("__json", "$.points", "variant")
    items = F.when(raw.isNull() & is_object, F.array().cast("array<variant>")).otherwise(M.elements(raw))
    staged = staged.withColumns({"__items": F.when(is_object, items), "__issues": F.try_variant_get("__json", "$.total_issues", "variant")})

    def get(point: Column, field: str) -> Column:
        return F.try_variant_get(point, f"$.{field}", "variant")

    def text_of(point: Column) -> Column:
        value = get(point, "text")
        return F.when(M.kind(value) == "STRING", strip(value.try_cast("string")))

    def valid(point: Column) -> Column:
        named = get(point, "point_type").try_cast("string").isin(POINT_TYPES)
        return F.coalesce((M.kind(point) == "OBJECT") & named & (F.length(text_of(point)) >= 10), F.lit(False))

    def build(point: Column, i: Column) -> Column:
        texts = ("issue_addressed", "scope", "limitations", "evidence_type", "admissibility_ruling", "weight_given",
                 "strength_assessment", "dissenting_judge")
        return F.struct(
            i.cast("int").alias("sequence"), get(point, "point_type").try_cast("string").alias("point_type"),
            text_of(point).alias("text"), M.safe_longs(get(point, "source_paragraphs")).alias("source_paragraphs"),
            M.safe_texts(get(point, "sections_cited")).alias("sections_cited"),
            M.safe_texts(get(point, "precedents_cited")).alias("precedents_cited"),
            *(M.safe_text(get(point, f)).alias(f) for f in texts),
            M.safe_share(get(point, "extraction_confidence")).alias("extraction_confidence"),
        )

    staged = staged.withColumn("__valid", F.filter("__items", valid))
    n_raw, n_valid = F.coalesce(F.size("__items"), F.lit(0)), F.coalesce(F.size("__valid"), F.lit(0))
    error = F.when(~F.coalesce(is_object, F.lit(False)), "answer is not an object").when(
        F.col("__items").isNull(), "points field is not a list"
    )
    points = F.coalesce(F.transform("__valid", build), F.array())
    whole = F.when(M.kind(F.col("__issues")) == "BIGINT", F.col("__issues").try_cast("bigint"))
    meta = F.struct(
        n_raw.alias("raw_count"), n_valid.alias("valid_count"), (n_raw - n_valid).alias("skipped_count"), error.alias("error")
    )
    return staged.withColumns(
        {into: points, "total_issues": F.coalesce(whole, F.lit(0)), f"{into}_meta": meta}
    ).drop("__json", "__items", "__valid", "__issues")


def parse_summary(answer: Column) -> Column:
    """Trimmed 'summary' of the answer, '' when there is none."""
    value = F.try_variant_get(F.try_parse_json(M.without_fence(answer)), "$.summary", "string")
    return F.coalesce(strip(value), F.lit(""))


def payload_json(tier_a: Column, tier_b: Column) -> Column:
    """Flat payload of both records: nulls are dropped, empty lists kept."""
    inner = F.concat(F.substring(F.to_json(tier_a), F.lit(2), F.length(F.to_json(tier_a)) - 2), F.lit(","),
                     F.substring(F.to_json(tier_b), F.lit(2), F.length(F.to_json(tier_b)) - 2))
    return F.concat(F.lit("{"), F.regexp_replace(inner, "^,|,$", ""), F.lit("}"))
