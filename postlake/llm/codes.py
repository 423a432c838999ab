"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found in a GNAT over the entries. A node picks split points among its entries
and gives each other entry to its closest split point; for each pair of a split point and a subset
it keeps the least and the largest distance between them. A query measures its distance to a split
point and drops every subset whose range, seen from there, lies farther away than the best entry
so far. Dropping is strict and every root is rounded outwards, so no entry that may be nearest or
tie is lost; distances themselves are compared in integers.

All queries of a batch walk the tree together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import stored
from postlake.llm.grid import floor_means, integers, lists, matrix, slices, squared, summed, wider, whole

#: Vectors that walk a tree together.
ROWS = 4096
#: Split points of a node, and entries below which a subset is compared one by one.
DEGREE, LEAF = 8, 4
_FAR = np.iinfo(np.int64).max


def _root_down(squares: np.ndarray) -> np.ndarray:
    """A float at most the root of an integer."""
    return np.maximum(0.0, np.nextafter(np.sqrt(np.nextafter(squares.astype(float), -np.inf).clip(0)), -np.inf))


def _root_up(squares: np.ndarray) -> np.ndarray:
    """A float at least the root of an integer."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(float), np.inf)), np.inf)


class _Node:
    """Split points, their subsets, and the range of distances of each subset from each split point."""

    def __init__(self, entries: np.ndarray, members: np.ndarray) -> None:
        self.splits = self._chosen(entries, members)
        s = len(self.splits)
        rest = members[~np.isin(members, self.splits)]
        far = np.stack([squared(entries[rest], entries[i]) for i in self.splits])
        owner = far.argmin(0) if len(rest) else np.zeros(0, int)
        self.low, self.high = np.full((s, s), np.inf), np.full((s, s), -np.inf)
        self.subsets: list[np.ndarray] = [rest[owner == j] for j in range(s)]
        self.children: list[_Node | None] = []
        for j, subset in enumerate(self.subsets):
            # A subset's own split point is measured when it is met, so it counts for the others' ranges only.
            held = np.append(subset, self.splits[j])
            for i, point in enumerate(self.splits):
                of = squared(entries[subset if i == j else held], entries[point])
                if len(of):
                    self.low[i, j], self.high[i, j] = _root_down(of.min(keepdims=True))[0], _root_up(of.max(keepdims=True))[0]
            self.children.append(_Node(entries, subset) if len(subset) > LEAF else None)

    @staticmethod
    def _chosen(entries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Members far from one another, beginning with the first."""
        chosen, nearest = [0], squared(entries[members], entries[members[0]])
        while len(chosen) < min(DEGREE, len(members)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(entries[members], entries[members[chosen[-1]]]))
        if nearest.max() == 0:  # all others are copies of these
            return members
        return members[chosen]


class Gnat:
    """Nearest entry of a codebook; of equally near ones the first."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = _Node(entries, np.arange(len(entries))) if len(entries) else None

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of and squared distance to the nearest entry of each query, and the distances measured."""
        best, found = np.full(len(queries), _FAR), np.zeros(len(queries), np.int32)
        measured = 0

        def measure(rows: np.ndarray, entry: int) -> np.ndarray:
            nonlocal measured
            measured += len(rows)
            d = squared(queries[rows], self.entries[entry])
            better = (d < best[rows]) | ((d == best[rows]) & (entry < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], entry
            return d

        def visit(node: _Node, rows: np.ndarray) -> None:
            alive = np.ones((len(rows), len(node.splits)), bool)
            low = np.full(alive.shape, -np.inf)  # bounds of the distances measured
            high = np.full(alive.shape, np.inf)

            def drop(at: np.ndarray, i: int) -> None:
                reach = _root_up(best[rows[at]])
                above = np.nextafter(low[at, i] - reach, -np.inf)[:, None] > node.high[i]
                below = np.nextafter(high[at, i] + reach, np.inf)[:, None] < node.low[i]
                alive[at] &= ~(above | below)

            for i, split in enumerate(node.splits):
                at = np.flatnonzero(alive[:, i])
                if len(at):
                    d = measure(rows[at], int(split))
                    low[at, i], high[at, i] = _root_down(d), _root_up(d)
                    drop(at, i)
            for i in range(len(node.splits)):  # the best has come nearer since
                drop(np.flatnonzero(np.isfinite(high[:, i])), i)
            for j, subset in enumerate(node.subsets):
                there = rows[alive[:, j]]
                if not len(subset) or not len(there):
                    continue
                if node.children[j] is not None:
                    visit(node.children[j], there)
                else:
                    for entry in subset:
                        measure(there, int(entry))

        if self.root is not None and len(queries):
            visit(self.root, np.arange(len(queries)))
        return found, best, measured


def compress(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    keep: Sequence[str] = (),
    parts: int = 4,
    size: int = 256,
    rounds: int = 4,
    dims: int = 64,
    scale: int = 1024,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of every whole vector (key, kept columns, codes, error), and the codebook of each part.

    ``codes`` holds an index per part, ``error`` the squared distances to those entries, summed.
    Vectors that are null, hold a null or non-finite component or have not ``dims`` components (so can't
    be cut like the others) are left out. Codebooks start as the parts of the ``size`` smallest keys
    (null keys last, equal keys by the vector's integers; repeated rows count as often as they occur);
    fewer vectors make smaller codebooks. ``rounds`` times every part goes to its nearest entry (ties:
    the first) and entries with parts become their floored means; then parts are assigned again. An
    empty table gives an empty one. Columns in ``keep`` named codes or error are replaced.

    A round reads the vectors and shuffles one row per task and entry.
    """
    if dims % parts:
        raise ValueError("parts must divide dims")
    held = [c for c in dict.fromkeys([key, *keep]) if c not in ("codes", "error")]
    rows = df.where(whole(F.col(vector), dims)).select(
        *[df[c] for c in held], integers(F.col(vector), scale).alias("_ints")
    )
    kept = stored(rows, "vectors")
    first = kept.orderBy(F.col(key).asc_nulls_last(), "_ints").select("_ints").limit(size).collect()
    books = np.split(np.array([r["_ints"] for r in first], np.int64).reshape(-1, dims), parts, axis=1)
    for _ in range(rounds if len(first) else 0):
        found = summed(_totals(kept, books), ["part", "entry"], dims // parts)
        books = [floor_means(b, [r for r in found if r["part"] == p], "entry") for p, b in enumerate(books)]
    return stored(_coded(kept, held, books), "codes"), books


def _assign(batch: pa.RecordBatch, trees: list[Gnat]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of the vectors of a batch: the parts, their entries and distances."""
    width = trees[0].entries.shape[1]
    rows = matrix(batch, "_ints", width * len(trees))
    for p, tree in enumerate(trees):
        part = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
        found, far, _ = tree.nearest(part)
        yield part, found, far


def _totals(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Counts and sums of the parts of each entry, as far as a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in slices(batches, ROWS):
            for p, (part, found, _) in enumerate(_assign(batch, trees)):
                counts[p] += np.bincount(found, minlength=len(books[p]))
                np.add.at(totals[p], found, part)
        for p, (n, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), lists(total[used])],
                names=["part", "entry", "n", "total"],
            )

    return kept.select("_ints").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")


def _coded(kept: DataFrame, held: list[str], books: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in slices(batches, ROWS):
            found, far = zip(*((f, d) for _, f, d in _assign(batch, trees)))
            columns = [batch.column(i) for i in range(len(held))]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists(np.stack(found, 1)), pa.array(np.sum(far, axis=0))], names=[*held, "codes", "error"]
            )

    schema = wider(kept.select(*held), "codes array<bigint>, error bigint")
    return kept.select(*held, "_ints").mapInArrow(run, schema)


def decompress(codes: Sequence[int], books: list[np.ndarray]) -> np.ndarray:
    """The vector of integers that a code stands for."""
    return np.concatenate([book[i] for i, book in zip(codes, books)])


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add the error summed over the rows of equal label (nulls are one label).

    Summed first and joined back, so a label of a third of all rows is no single task's work.
    """
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(F.col("_label")), "left").drop("_label")
