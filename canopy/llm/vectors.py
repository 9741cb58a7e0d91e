"""Embedding columns as numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, vectors) of the rows that hold a vector: not null, no null or non-finite component, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, out = [], []
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    for i, v in enumerate(column):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(kind)
        if np.isfinite(x).all() and x.any():
            rows.append(i)
            out.append(x)
    return np.array(rows, np.int64), out


def by_length(sizes: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each distinct size."""
    return [np.nonzero(sizes == s)[0] for s in np.unique(sizes)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` in double precision at length 1, scaled first so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
