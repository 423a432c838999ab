"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.session import scratch_path


#: Rows worked on at a time in a task, so that a batch of long texts takes little memory.
ROWS = 512


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which cuts its lineage there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def with_columns(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that ``make`` computes from each Arrow batch; columns of those names are replaced.

    ``keep`` names the columns to carry along (default: all that are not replaced).
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + list(make(batch))
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def texts_in(batch: pa.RecordBatch, column: str) -> list[str]:
    """A batch's texts, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def sample_keys(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct keys, chosen by hash: the same ones at every run and partitioning."""
    order = F.xxhash64(F.col(key).cast("string"))
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.orderBy(order, key).limit(bound)


def sample_rows(df: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct rows (key, text), chosen by the hashes of key, then text; null keys are left out.

    So a key that very many rows share gives no more rows than any other bound of the same size. The
    last pair of hashes that is taken is found first, by a distinct and an ordered limit of hashes.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    rows = df.where(F.col(key).isNotNull()).select(h.alias("_k"), F.xxhash64(F.col(text).cast("string")).alias("_t"), key, text)
    pairs = rows.select("_k", "_t").distinct().orderBy("_k", "_t").limit(bound)
    last = pairs.agg(F.max(F.struct("_k", "_t")).alias("m")).first()["m"]
    if last is None:
        return rows.limit(0).select(key, text)
    taken = (F.col("_k") < last["_k"]) | ((F.col("_k") == last["_k"]) & (F.col("_t") <= last["_t"]))
    return rows.where(taken).dropDuplicates(["_k", "_t"]).select(key, text)


def by_group(
    df: DataFrame,
    keys: Sequence[str],
    schema: str,
    work: Callable[[dict[str, np.ndarray]], Sequence[np.ndarray] | None],
    order: Sequence[str] = (),
    least: int = 1,
) -> DataFrame:
    """Call ``work`` with the columns of each group of ``keys`` and collect the rows it returns.

    Rows are dealt out by the keys and read as a sorted stream, so a task holds one group and one
    batch at a time. Callers see to it that a group has a bound. ``work`` returns arrays in the
    order of ``schema``, or None. Groups of fewer than ``least`` rows are passed over, unless the
    rows have a column parts with more than 1.
    """
    keys, names = list(keys), df.columns
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    types = df.sparkSession.createDataFrame([], schema).schema
    arrow = [_ARROW[f.dataType.simpleString()] for f in types]

    def out(parts: list[Sequence[np.ndarray]]) -> pa.RecordBatch:
        columns = [
            pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kind) for i, kind in enumerate(arrow)
        ]
        return pa.RecordBatch.from_arrays(columns, names=types.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, object) for c in names}

        def groups(last: bool) -> Iterator[dict[str, np.ndarray]]:
            nonlocal held
            size = len(held[names[0]])
            if not size:
                return
            new = np.zeros(size, bool)
            for c in keys:
                new[1:] |= held[c][1:] != held[c][:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            ends = np.concatenate([starts[1:], [size]])
            stop = len(starts) if last else len(starts) - 1
            wanted = ends[:stop] - starts[:stop] >= least
            if "parts" in held:
                wanted |= held["parts"][starts[:stop]] > 1
            for s, e in zip(starts[:stop][wanted], ends[:stop][wanted]):
                yield {c: v[s:e] for c, v in held.items()}
            held = {c: v[size if last else starts[-1] :] for c, v in held.items()}

        for batch in batches:
            now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            held = {c: np.concatenate([held[c], now[c]]) if len(held[c]) else now[c] for c in names}
            yield out([r for g in groups(False) if (r := work(g)) is not None])
        yield out([r for g in groups(True) if (r := work(g)) is not None])

    return dealt.mapInArrow(run, types)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
