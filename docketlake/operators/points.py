"""Points: what a judgment becomes in the searchable collection, and the collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketlake.functions import identity as I
from docketlake.functions.text import is_blank, strip
from docketlake.operators.collection import Collection
from docketlake.operators.segmentation import SINGLE_LIMIT, with_chunks

_ENTRY = {
    "point_type": "string", "sequence": "string", "text": "string", "chunk_index": "int", "total_chunks": "int",
    "section_type": "string", "tier_c_field": "string", "reasoning_point_type": "string", "reasoning_sequence": "int",
    "issue_addressed": "string", "evidence_type": "string", "reasoning_metadata": "string",
}


def _entry(**values: Column) -> Column:
    return F.struct(
        *(values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _ENTRY.items())
    )


def reject_reason(text: Column, court: Column, number: Column) -> Column:
    return (
        F.when(is_blank(text), "empty text")
        .when(F.coalesce(number, F.lit("")) == "", "no case number")
        .otherwise(I.key_error(court, number))
    )


def split_rejects(docs: DataFrame, text: str = "text", court: str = "court", number: str = "case_number") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with ``reject_reason``): a bad row never stops a batch."""
    reason = reject_reason(F.col(text), F.col(court), F.col(number))
    return docs.filter(reason.isNull()), docs.filter(reason.isNotNull()).withColumn("reject_reason", reason)


def build_points(
    docs: DataFrame, payload: Sequence[str] = (), single_limit: int = SINGLE_LIMIT,
    tier_c: str | None = None, reasoning: str | None = None, summary: str | None = None,
) -> DataFrame:
    """One row per point: chunks or the full text, then passages, then reasoning points.

    Needs text, court and case_number; ``payload`` columns are carried along.
    ``tier_c`` names a struct of passages, ``reasoning`` an array of points. All
    points of a row are made inside that row and exploded once: one scan, no union,
    no shuffle.
    """
    c = F.col
    usable, _ = split_rejects(docs)
    base = with_chunks(usable, "text", "__chunks", single_limit)
    one = F.array(_entry(point_type=F.lit("full_text"), sequence=F.lit("0"), text=c("text")))
    many = F.transform(
        c("__chunks"),
        lambda k, i: _entry(
            point_type=F.lit("chunk"), sequence=i.cast("string"), text=strip(k["raw"]), chunk_index=i,
            total_chunks=F.size("__chunks"), section_type=k["section_type"],
        ),
    )
    entries = [F.when(F.size("__chunks") > 1, many).otherwise(one)]
    if tier_c:
        fields = docs.schema[tier_c].dataType.fieldNames()
        passages = F.array(
            *(_entry(point_type=F.lit("tier_c"), sequence=F.lit(f), text=c(f"{tier_c}.{f}"), tier_c_field=F.lit(f)) for f in fields)
        )
        entries.append(F.filter(passages, lambda e: ~is_blank(e["text"])))
    if reasoning:
        inner: StructType = docs.schema[reasoning].dataType.elementType
        rest = [f for f in inner.fieldNames() if f not in ("sequence", "point_type", "text")]
        points = F.transform(
            F.filter(c(reasoning), lambda r: ~is_blank(r["text"]) & r["sequence"].isNotNull() & r["point_type"].isNotNull()),
            lambda r: _entry(
                point_type=F.lit("reasoning"), sequence=r["sequence"].cast("string"), text=r["text"],
                reasoning_point_type=r["point_type"], reasoning_sequence=r["sequence"],
                # Indexed fields stand at the top, where filters look for them.
                issue_addressed=r["issue_addressed"] if "issue_addressed" in rest else F.lit(None),
                evidence_type=r["evidence_type"] if "evidence_type" in rest else F.lit(None),
                reasoning_metadata=F.to_json(F.struct(*(r[f].alias(f) for f in rest))),
            ),
        )
        entries.append(F.coalesce(points, F.array().cast(_array_type())))
    base = base.withColumn("__entries", F.concat(*entries))
    keep = [p for p in payload if p not in ("court", "case_number", "text")]
    sac = [c(summary).alias("sac_summary")] if summary else []
    rows = base.select("court", "case_number", *keep, *sac, F.explode_outer("__entries").alias("__e"))
    key = I.point_key(c("court"), c("case_number"), c("__e.point_type"), c("__e.sequence"))
    parent = I.parent_key(c("court"), c("case_number"))
    return rows.select(
        I.name_uuid(key).alias("point_uuid"), key.alias("point_key"), I.name_uuid(parent).alias("parent_case_id"),
        parent.alias("parent_case_key"), c("court").alias("court_code"), "case_number", *keep,
        *(["sac_summary"] if summary else []), *(c(f"__e.{n}") for n in _ENTRY if n != "sequence"),
    )


def _array_type() -> str:
    return "array<struct<" + ",".join(f"{n}:{k}" for n, k in _ENTRY.items()) + ">>"


# ── collection ──
def upsert(spark: SparkSession, new: DataFrame, path: str, version: str) -> int:
    """Writes points by id, the highest ``version`` wins; running it twice changes nothing. Returns the points added."""
    return Collection(spark, path).upsert(new, version)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return Collection(spark, path).read()


def collection_exists(spark: SparkSession, path: str) -> bool:
    return Collection(spark, path).exists()


def create_collection(spark: SparkSession, path: str, schema: StructType) -> bool:
    """Empty collection; False when it is there already."""
    return Collection(spark, path).create(schema)


def delete_collection(spark: SparkSession, path: str) -> bool:
    return Collection(spark, path).delete()


def collection_info(spark: SparkSession, path: str) -> dict:
    return Collection(spark, path).info()
