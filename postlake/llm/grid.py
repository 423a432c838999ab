"""Vectors of integers: what the operators on quantised vectors share.

A component x becomes floor(scale * x), as double. Components beyond +-``LIMIT`` count as that, so that
a squared distance of ``dims`` components fits a long; up to there all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2**27


def whole(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null or non-finite. A null vector has not."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array of int."""
    bound = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x))
    return F.transform(vector, lambda x: F.floor(bound(x.cast("double") * scale)).cast("int"))


def wider(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with more fields behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of 64-bit integers."""
    flat = batch.column(batch.schema.get_field_index(column)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of 64-bit integers as an Arrow list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, np.int64).ravel()))


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def summed(parts: DataFrame, keys: list[str], width: int) -> list:
    """Add up the partial counts and sums (columns n and total) that tasks give per key, at most one row a key.

    The number of keys is a parameter of the operator (centroids, entries), so the rows collected are few.
    """
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *sums).collect()


def floor_means(points: np.ndarray, found: list, key: str) -> np.ndarray:
    """The points with those that have members replaced by floor(sum / count), component by component."""
    moved = points.copy()
    for row in found:
        moved[row[key]] = [row[f"s{i}"] // row["n"] for i in range(points.shape[1])]
    return moved
