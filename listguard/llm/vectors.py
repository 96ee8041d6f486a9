"""Vectors in Arrow batches, and bounded pivot samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold only finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column without nulls, of one length, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1)


def spread_sample(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows far from each other: each next one is the farthest from those chosen."""
    if not len(points):
        return points
    chosen, distance = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def sampled(df: DataFrame, vector: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, the first by hash: a sample for pivots, which only steer the work."""
    some = df.select(F.xxhash64(vector).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(rows).toArrow()
    return matrix(some["v"])
