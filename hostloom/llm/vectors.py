"""Embeddings as exact integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
# Components are below this, so that squared distances and products of up to 128 components fit 64 bits.
COMPONENT_LIMIT = 1 << 27


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def scaled(vector: Column) -> Column:
    """floor(256 x) of every component. A component of 2**27 or more in size is an error, as results would not fit."""
    too_large = F.exists(vector, lambda x: F.abs(x.cast("double")) >= COMPONENT_LIMIT / SCALE)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return F.when(too_large, F.raise_error(F.lit("a vector's component is too large"))).otherwise(whole)


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as 64-bit integers; shorter rows are filled with 0."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    lengths = [np.diff(a.offsets.to_numpy(zero_copy_only=False)) for a in arrays]
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    flat = [a.flatten().to_numpy(zero_copy_only=False) for a in arrays]
    flat = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
    width = max(width or 0, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
