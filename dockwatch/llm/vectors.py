"""Vectors in columns and in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def is_finite(vec: str) -> Column:
    """True for vectors that are not null and hold only finite components."""
    good = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & good, F.lit(False))


def matrix(lists: pa.Array, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """Rows of a list array as a matrix; shorter rows are filled with zeros."""
    n = len(lists)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = max(width or 0, int(sizes.max()) if n else 0)
    if n and (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), dtype=dtype)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n):
        out[i, :sizes[i]] = flat[at[i]:at[i + 1]]
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))
