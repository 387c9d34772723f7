"""Dense search in two passes: one byte per dimension first, whole vectors for the few that matter.

``build`` stores beside each vector its one-byte form, the step of that form, the length of what
it leaves out and the vector's own length. The first pass reads these columns only, about a
third of the bytes: by Cauchy and Schwarz the true cosine lies within (what is left out) / (own
length) of the one computed from bytes. The k-th best lower bound is reached by k rows, so rows
whose upper bound is below it are no hits. The second pass reads whole vectors of the others
and ranks them exactly: the result equals a full scan, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.search import search_dense

#: Room for rounding in the bounds, and how many keys are named in the second scan; more are joined.
SLACK, NAMED = 1e-6, 1000
_FORM = "struct<bytes:binary,step:float,beyond:float,length:float>"


def quantized(vector: Column) -> Column:
    """One-byte form of a vector; null for vectors that are null, empty or hold a null, NaN or infinity."""
    @F.arrow_udf(_FORM)
    def form(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = None if v.as_py() is None or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if x is None or not np.isfinite(x).all():
                out.append(None)
                continue
            step = float(np.float32(np.abs(x).max() / 127)) or 1.0
            b = np.clip(np.rint(x / step), -127, 127).astype(np.int8)
            out.append({"bytes": b.tobytes(), "step": step, "beyond": float(np.linalg.norm(x - step * b)), "length": float(np.linalg.norm(x))})
        kinds = [("bytes", pa.binary()), ("step", pa.float32()), ("beyond", pa.float32()), ("length", pa.float32())]
        return pa.array(out, pa.struct(kinds))

    return form(vector)


def build(points: DataFrame, path: str, key: str, vector: str = "dense", carried: Sequence[str] = ()) -> None:
    """Writes points with a vector, in key order, so that the second pass finds its rows in few pages."""
    held = points.filter(F.col(vector).isNotNull()).select(key, *carried, vector)
    held = held.withColumn("small", quantized(F.col(vector)))
    held.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", str(8 << 20)).parquet(path)


def bounds(small: Column, query: Sequence[float]) -> Column:
    """(low, high) around the cosine of the stored vector and the query; null for another length."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf("struct<low:double,high:double>")
    def near(forms: pa.Array) -> pa.Array:
        flat = forms.flatten()  # a null form has null fields
        fit = pc.binary_length(flat[0]).fill_null(-1).to_numpy(zero_copy_only=False) == len(q)
        rows = np.frombuffer(b"".join(flat[0].filter(pa.array(fit)).to_pylist()), np.int8).reshape(-1, len(q)).astype(np.float64)
        step, beyond, length = (a.filter(pa.array(fit)).to_numpy(zero_copy_only=False).astype(np.float64) for a in flat[1:])
        length[length == 0] = 1.0
        middle, off = step * (rows @ q) / length, beyond / length * (1 + SLACK) + SLACK
        ends = np.full((2, len(fit)), np.nan)
        ends[:, fit] = middle - off, middle + off
        return pa.StructArray.from_arrays([pa.array(e, mask=~fit) for e in ends], names=["low", "high"])

    return near(small)


def candidates(spark: SparkSession, path: str, query: Sequence[float], key: str, limit: int, where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(key) of all rows that may be among the best ``limit``."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.filter(where(rows))
    near = rows.select(key, bounds(F.col("small"), query).alias("at")).select(key, "at.low", "at.high")
    kth = near.orderBy(F.desc_nulls_last("low")).limit(limit).collect()  # limit numbers
    if len(kth) == limit and kth[-1]["low"] is not None:
        near = near.filter(F.col("high") >= kth[-1]["low"])
    return near.filter("high IS NOT NULL").select(key)


def search(
    spark: SparkSession, path: str, query: Sequence[float], limit: int = 10, key: str = "point_uuid", vector: str = "dense",
    where: Callable[[DataFrame], Column] | None = None, score_threshold: float | None = None,
) -> DataFrame:
    """As search_dense over the stored points, without the one-byte form."""
    found = candidates(spark, path, query, key, limit, where)
    rows = spark.read.parquet(path).drop("small")
    named = [r[0] for r in found.limit(NAMED + 1).collect()]
    rows = rows.filter(F.col(key).isin(named)) if len(named) <= NAMED else rows.join(found, key, "left_semi")
    if where is not None:
        rows = rows.filter(where(rows))
    return search_dense(rows, query, limit, None, score_threshold, key, vector)
