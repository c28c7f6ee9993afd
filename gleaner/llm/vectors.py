"""Vectors of whole numbers: from a table of embeddings to numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = float(1 << 53)  # whole numbers below it are doubles


def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors that hold finite numbers only: x is floor(scale * component) as doubles."""
    entry = F.col("embedding").cast("array<double>")
    odd = F.exists(entry, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = F.transform(entry, lambda e: F.when(F.abs(scale * e) < EXACT, F.floor(scale * e).cast("double")).otherwise(scale * e))
    return embeddings.filter(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), scaled.alias("x"))


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    """Rows with zeros at their end."""
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones get zeros at their end."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out
