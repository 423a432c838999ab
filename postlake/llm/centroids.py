"""Centroid clustering of integer vectors, with centroids filtered by n-simplex projection.

The distances of a vector to a few pivots are measured once and kept. They place the vector as the
apex of a simplex over the pivots: its coordinates in the pivots' own space, and its altitude above
it. For two vectors the Euclidean distance of their apexes is a lower bound of their distance, and
with one altitude mirrored it is an upper bound. Centroids are placed the same way each round; a
centroid whose lower bound is above a vector's least upper bound cannot be the nearest, and only
what is left is compared, exactly, in integers.

Bounds are floating-point numbers, so the filter leaves room for their error (``Simplex.slack``): it
never drops a centroid that may be nearest or tie, and the result doesn't depend on the pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import stored
from postlake.llm.grid import floor_means, integers, lists, matrix, slices, squared, summed, wider, whole

#: Rows compared with the centroids at a time.
ROWS = 4096
#: A pivot nearer to the span of the others than this share of the simplex adds nothing but rounding errors.
FLAT = 1e-3


class Simplex:
    """A simplex over up to ``most`` of some points, and the apexes of other points above it."""

    def __init__(self, points: np.ndarray, most: int = 8) -> None:
        self.pivots = points[:1]
        self._set(np.zeros((1, 0)))
        while len(points) and len(self.pivots) < most:
            apexes = self.apexes(self.distances(points))
            altitude = apexes[:, -1]
            best, size = int(altitude.argmax()), float(np.sqrt(self.distances(points)[:, 0].max()))
            if altitude[best] <= FLAT * size:
                break
            vertices = np.pad(self.vertices, ((0, 1), (0, 1)))
            vertices[-1] = apexes[best]
            self.pivots = np.vstack([self.pivots, points[best]])
            self._set(vertices)

    def _set(self, vertices: np.ndarray) -> None:
        """Vertices are rows, the first one at 0, each with one coordinate more than the one before."""
        self.vertices, base = vertices, vertices[1:]
        self._solve = np.linalg.inv(base).T if len(base) else base.T
        self._norms = self.distances(self.pivots)[:, 0] if len(self.pivots) else np.zeros(0, np.int64)
        condition = np.linalg.cond(base) if len(base) else 1.0
        # An altitude is a root, so an error e of its square may show as sqrt(e).
        self.slack = 4 * np.sqrt(64 * max(1, len(vertices)) * np.finfo(float).eps * condition)

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Exact squared distances to every pivot, one column each."""
        return np.stack([squared(rows, p) for p in self.pivots], 1) if len(self.pivots) else np.zeros((len(rows), 0))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from the squared distances to the pivots; the last one is the altitude."""
        first = distances[:, :1]
        span = ((first - distances[:, 1:] + self._norms[1:]) / 2.0) @ self._solve
        altitude = np.sqrt(np.maximum(0.0, first[:, 0] - (span * span).sum(1)))
        return np.column_stack([span, altitude])

    def bounds(self, distances: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of the distances between two sets of points, with room for rounding."""
        a, b = self.apexes(distances), self.apexes(others)
        sizes = distances[:, :1].astype(float) + others[:, 0]
        middle = sizes - 2 * a[:, :-1] @ b[:, :-1].T
        mirrored = 2 * np.outer(a[:, -1], b[:, -1])
        room = self.slack * sizes
        return middle - mirrored - room, middle + mirrored + room


def nearest(
    rows: np.ndarray, centroids: np.ndarray, simplex: Simplex, distances: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid (ties: the smaller number), and how many were compared."""
    low, high = simplex.bounds(distances, simplex.distances(centroids))
    open_ = low <= high.min(1)[:, None]
    best = np.full(len(rows), np.iinfo(np.int64).max)
    found = np.zeros(len(rows), np.int32)
    for c, centroid in enumerate(centroids):
        at = np.flatnonzero(open_[:, c])
        d = squared(rows[at], centroid)
        less = d < best[at]
        best[at[less]], found[at[less]] = d[less], c
    return found, best, int(open_.sum())


def start(rows: DataFrame, key: str, k: int, salt: str) -> np.ndarray:
    """The k vectors whose sha256 of salt:key is smallest, in that order; equal hashes by the vector's integers.

    A null key hashes as an empty one. k is a parameter, so the rows collected are few.
    """
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("_hash"), "_ints").orderBy("_hash", "_ints").limit(k).collect()
    return np.array([r["_ints"] for r in first], np.int64)


def cluster(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    pivots: int = 8,
    salt: str = "2",
) -> tuple[DataFrame, np.ndarray]:
    """Cluster of every whole vector (key, cluster, distance), and the centroids.

    Vectors that are null, have not ``dims`` components, or hold a null or non-finite one are left out.
    ``rounds`` times every vector goes to the nearest centroid (ties: the smaller number), and centroids
    with vectors become their floored means; then vectors are assigned once more. With fewer than
    ``k`` vectors there are as many centroids. Repeated rows count as often as they occur; rows with
    a null key take part; an empty table gives an empty one. Other columns are left out.

    A round reads the kept vectors and shuffles one row per task and centroid.
    """
    rows = df.where(whole(F.col(vector), dims)).select(F.col(key), integers(F.col(vector), scale).alias("_ints"))
    centroids = start(rows, key, k, salt).reshape(-1, dims)
    simplex = Simplex(centroids, pivots)
    kept = stored(_with_distances(rows, simplex, dims), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = floor_means(centroids, summed(_totals(kept, centroids, simplex), ["cluster"], dims), "cluster")
    return stored(_assigned(kept, key, centroids, simplex), "clusters"), centroids


def _with_distances(rows: DataFrame, simplex: Simplex, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            far = simplex.distances(matrix(batch, "_ints", dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(far)], names=[*batch.schema.names, "_far"])

    return rows.mapInArrow(run, wider(rows, "_far array<bigint>"))


def _totals(kept: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """Counts and sums of the vectors of each centroid, as far as a task has read."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in slices(batches, ROWS):
            rows = matrix(batch, "_ints", dims)
            found, _, _ = nearest(rows, centroids, simplex, matrix(batch, "_far", len(simplex.pivots)))
            counts += np.bincount(found, minlength=k)
            np.add.at(totals, found, rows)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), lists(totals[used])], names=["cluster", "n", "total"]
        )

    return kept.select("_ints", "_far").mapInArrow(run, "cluster int, n bigint, total array<bigint>")


def _assigned(kept: DataFrame, key: str, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows = matrix(batch, "_ints", centroids.shape[1])
            found, best, _ = nearest(rows, centroids, simplex, matrix(batch, "_far", len(simplex.pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array(best)], names=[key, "cluster", "distance"]
            )

    schema = wider(kept.select(key), "cluster int, distance bigint")
    return kept.select(key, "_ints", "_far").mapInArrow(run, schema)


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the distances summed over the cluster and over all, and the digest of the final centroid.

    One row per centroid is collected and joined back; their number is a parameter.
    """
    spent = {r["cluster"]: r["spent"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("spent")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = [(c, spent[c], digest) for c, digest in enumerate(digests) if c in spent]
    facts = assigned.sparkSession.createDataFrame(of, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").withColumn("inertia", F.lit(sum(spent.values())).cast("bigint"))
