"""Vectors as bytes in Arrow batches, and cosines in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


def element_type(column: T.ArrayType) -> str:
    """numpy type that holds the components as they came."""
    return "f4" if isinstance(column.elementType, T.FloatType) else "f8"


def vector_bytes(column: pa.Array, dtype: str) -> list[bytes | None]:
    """Components of each vector; None for one that is null, empty, zero or holds null or non-finite components."""
    out: list[bytes | None] = []
    for value in column.to_pylist():
        if not value or None in value:
            out.append(None)
            continue
        vector = np.array(value, dtype=dtype)
        out.append((vector + vector.dtype.type(0)).tobytes() if np.isfinite(vector).all() and vector.any() else None)
    return out


def matrix(blobs: list[bytes], dtype: str) -> np.ndarray:
    """Vectors of one length in double precision, each scaled by a power of two so that no square overflows."""
    rows = np.frombuffer(b"".join(blobs), dtype=dtype).astype(np.float64).reshape(len(blobs), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def cosines(rows: np.ndarray, row_norms: np.ndarray, query: np.ndarray, query_norm: float) -> np.ndarray:
    """Cosine of each row with the query; equal rows get equal cosines wherever they stand."""
    return (rows * query).sum(axis=1) / (row_norms * query_norm)
