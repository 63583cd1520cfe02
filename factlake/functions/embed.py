"""Text embedding by signed feature hashing of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import FNV_OFFSET, FNV_PRIME, U64

#: Widths of the byte n-grams.
WIDTHS = (1, 2, 3)


def embed(text: str, dim: int) -> np.ndarray:
    """Each n-gram's FNV-1a hash adds 1 at hash % dim, or -1 if its top bit is set; then unit length.

    All windows of a width are hashed at once, a byte further in each step.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8).astype(U64)
    out = np.zeros(dim)
    with np.errstate(over="ignore"):
        for width in WIDTHS:
            n = len(data) - width + 1
            if n <= 0:
                continue
            h = np.full(n, FNV_OFFSET, dtype=U64)
            for i in range(width):
                h = (h ^ data[i : i + n]) * U64(FNV_PRIME)
            sign = np.where(h >> U64(63) == 1, -1.0, 1.0)
            out += np.bincount((h % U64(dim)).astype(np.int64), sign, dim)
    return (out / max(np.sqrt((out**2).sum()), 1e-6)).astype(np.float32)


def embed_text(text: Column, dim: int = 64) -> Column:
    """Embedding of a string column as array<float>; null for null and empty texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: embed(t, dim) if t else None)

    return run(text)
