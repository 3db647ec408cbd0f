"""Text embeddings.

The built-in embedder hashes words into buckets and stays in the JVM. A real model plugs in as an
iterator pandas UDF through ``model_embedder``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 64


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time per row: as a lambda argument it is
    not repeated wherever ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_counts(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Words per hash bucket; the bucket is the low byte of the word's md5 modulo the size, which
    equals the full digest modulo any power of two up to 256."""
    if dimensions not in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("dimensions must be a power of two up to 256")
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    buckets = F.transform(
        words, lambda w: F.conv(F.right(F.md5(w), F.lit(2)), 16, 10).cast("int") % dimensions
    )
    return once(
        buckets,
        lambda found: F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda b: F.size(F.filter(found, lambda x: x == b)),
        ),
    )


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return once(
            F.when(norm > 0, norm).otherwise(1.0), lambda n: F.transform(v, lambda x: x / n)
        )

    return once(vector, scaled)


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit-length bag-of-words vector."""
    return normalize(word_counts(text, dimensions))


def model_embedder(
    load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64
) -> Callable[[Column], Column]:
    """Wrap a model: ``load`` runs once per task and returns ``encode(texts) -> matrix``."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            values = texts.fillna("").tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(values), batch_size):
                matrix = np.asarray(encode(values[start : start + batch_size]), dtype=float)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                rows.extend(matrix / np.where(norms == 0, 1, norms))
            yield pd.Series(rows, index=texts.index)

    return embed
