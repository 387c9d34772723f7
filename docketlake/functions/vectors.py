"""Sparse term vectors and dense scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import every

# What counts as a term.
WORD = r"\b[a-z]{3,}\b"
SECTION_TERM = r"section\s+\d+[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?"
CITATION_TERM = r"\b(?:pld|scmr|clc|pcrlj|ptd|plc|cld|ylr|mld)\s+\d{4}\b"

SPARSE_TYPE = "struct<indices:array<bigint>,values:array<double>>"


def terms(text: Column) -> Column:
    """Words of three letters and more, section references, reporter-year pairs."""
    low = F.lower(text)
    return F.concat(every(low, WORD, 0), every(low, SECTION_TERM, 0), every(low, CITATION_TERM, 0))


def _run_starts(ordered: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(ordered) - 1)
    return F.filter(
        places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )


def term_counts(ordered: Column) -> Column:
    """(term, tf) pairs of an ordered, non-empty term array.

    Equal terms are neighbours after sorting, so a count is the distance between two
    run starts. A document is counted inside its row: nothing is shuffled.
    """
    starts = _run_starts(ordered)
    size = F.size(ordered)
    pairs = F.transform(
        F.arrays_zip(starts.alias("a"), F.slice(F.array_append(starts, size), 2, size + 1).alias("b")),
        lambda r: F.struct(
            F.get(ordered, r["a"]).alias("term"), (r["b"] - r["a"]).cast("double").alias("tf")
        ),
    )
    return F.when(size > 0, pairs)


def term_index(term: Column) -> Column:
    """First 32 bits of the term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def indexed(counts: Column) -> Column:
    """(idx, tf) pairs ordered by idx."""
    return F.sort_array(
        F.transform(counts, lambda c: F.struct(term_index(c["term"]).alias("idx"), c["tf"].alias("tf")))
    )


def merged(pairs: Column) -> Column:
    """Ordered pairs with one entry per idx: terms that share an index add up."""
    distinct = F.array_distinct(F.transform(pairs, lambda p: p["idx"]))
    summed = F.transform(
        distinct,
        lambda i: F.struct(
            i.alias("idx"),
            F.aggregate(
                F.filter(pairs, lambda p: p["idx"] == i), F.lit(0.0), lambda s, p: s + p["tf"]
            ).alias("tf"),
        ),
    )
    return F.when(F.size(distinct) == F.size(pairs), pairs).otherwise(summed)


def dot(indices: Column, values: Column, query: Column) -> Column:
    """Product over shared indices; null when none is shared.

    The arrays must be plain columns: they are read once per shared term.
    """
    shared = F.array_intersect(indices, query["indices"])

    def weight(places: Column, weights: Column, i: Column) -> Column:
        return F.element_at(weights, F.array_position(places, i).cast("int"))

    total = F.aggregate(
        shared,
        F.lit(0.0),
        lambda s, i: s + weight(indices, values, i) * weight(query["indices"], query["values"], i),
    )
    return F.when(F.size(shared) > 0, total)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one query vector, computed on Arrow batches."""
    q = np.asarray(query, dtype="float64")
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        # Vectors of another length than the query's have no score.
        valid = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False) == len(q)
        flat = vectors.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype("float64").reshape(-1, len(q))
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        norms[norms == 0] = 1.0
        out = np.full(len(valid), np.nan)
        out[valid] = np.einsum("ij,j->i", matrix, q) / norms
        return pa.array(out, mask=~valid)

    return score(vector)


def quantize(vector: Column) -> Column:
    """Lossy form: one signed byte per dimension, scaled to the largest magnitude."""
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    scaled = F.transform(vector, lambda x: F.round(x / peak * 127).cast("tinyint"))
    return F.struct(scaled.alias("values"), (peak / 127).alias("scale"))
