"""Embedding rows as distinct usable vectors, shared by the two embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows whose vector is not null, not zero and has only finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0.0)).withColumn(
        "v", F.transform("v", lambda x: x + F.lit(0.0)))       # -0.0 becomes 0.0: equal vectors are equal keys


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True) if len(m) else np.ones((0, 1))
    m = m / scale                                               # so that squares neither vanish nor overflow
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
