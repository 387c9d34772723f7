"""Dense vectors through a provider, in batches per task, with retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Batch size, tries and dimensions.
BATCH, TRIES, DIMENSIONS = 64, 3, 1024


class EmbeddingError(Exception):
    """All tries failed."""


class HashingEmbedder:
    """Stand-in without a network: hashed words, normalised. Equal text, equal vector."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str], mode: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                digest = hashlib.md5(word.encode()).digest()
                out[row, int.from_bytes(digest[:4], "big") % self.dimensions] += 1 if digest[4] & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    def info(self) -> dict:
        return {"provider": "hashing", "model": "words", "dimensions": self.dimensions, "max_context_tokens": None}


def embed_with_retry(provider, texts: Sequence[str], mode: str, tries: int = TRIES, wait_base: float = 2.0):
    for attempt in range(1, tries + 1):
        try:
            vectors = provider.embed(texts, mode)
            if len(vectors) != len(texts):
                raise EmbeddingError(f"sent {len(texts)} texts, got {len(vectors)} vectors")
            return vectors
        except Exception as error:
            if attempt == tries:
                raise EmbeddingError(f"failed after {tries} attempts: {error}") from error
            time.sleep(wait_base**attempt)
    return []


def embed_column(
    df: DataFrame, text: str, factory: Callable[[], object] = HashingEmbedder, into: str = "dense",
    mode: str = "document", pause: float = 0.0,
) -> DataFrame:
    """Adds vector ``into``; null and blank texts get null. ``pause`` seconds lie
    between provider calls of one task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for batch in batches:
            out: list = [None] * len(batch)
            todo = [i for i, t in enumerate(batch) if isinstance(t, str) and t.strip()]
            for start in range(0, len(todo), BATCH):
                part = todo[start : start + BATCH]
                for i, v in zip(part, embed_with_retry(provider, [batch.iloc[i] for i in part], mode)):
                    out[i] = v
                if pause and start + BATCH < len(todo):
                    time.sleep(pause)
            yield pd.Series(out)

    # Not deterministic: Spark must never copy the provider call into a second place.
    return df.withColumn(into, vectors.asNondeterministic()(F.col(text)))


def embed_query(query: str, provider=None) -> list[float]:
    return embed_with_retry(provider or HashingEmbedder(), [query], "query")[0]
