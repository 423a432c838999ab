"""Approximate nearest neighbours by NN-descent and greedy graph search, in Spark joins.

The index is a graph: each vector and its best neighbours so far. It starts from random groups and
groups of vectors on the same side of random planes, and improves in rounds: every node brings its
neighbours, and those it is a neighbour of, together with their vectors, and each learns of the
others that are nearer than what it has. A search walks the graph in rounds as well: the best
nodes found are expanded, their neighbours scored, the best kept. Equal vectors are one node.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import by_group, sample_keys, stored, with_columns


@dataclass(frozen=True)
class Settings:
    neighbours: int = 24  # kept per node
    reverse: int = 24  # nodes that a node is a neighbour of, at most so many join a round or a search
    tables: int = 5  # groupings by random planes to start from
    group: int = 64  # wanted size of a group; larger ones are split by hash
    delta: float = 0.02  # building goes on until a smaller share of the links changes in a round
    beam: int = 384  # nodes that a search keeps per query
    expand: int = 96  # nodes that it expands per round; it goes on until none of the kept ones is open
    entries: int = 256  # nodes chosen by hash that every search is offered as starting points


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: of the commonest length, finite, not zero."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("vector", lambda x: x != 0)
    )
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (length["n"] if length else 0))


def _packed(df: DataFrame) -> DataFrame:
    """Add unit, the vector at length one as half-precision bytes."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index("vector"))
        x = column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 1))
        x = x / np.abs(x).max(1, keepdims=True)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f2")
        return [pa.array([u.tobytes() for u in unit], pa.binary())]

    return with_columns(df, [T.StructField("unit", T.BinaryType())], make)


def _matrix(units: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f2").reshape(len(units), -1).astype(np.float32)


def _best(edges: DataFrame, n: int) -> DataFrame:
    """The n nearest of each node's candidates. Spark keeps n a node in every map task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def _start(nodes: DataFrame, n: int, s: Settings) -> DataFrame:
    """(u, v, sim) within groups on the same side of random planes, and within groups by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / s.group)))))
    tables, seeds = s.tables, np.random.SeedSequence(7).spawn(s.tables)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        units = batch.column(batch.schema.get_field_index("unit")).to_numpy(zero_copy_only=False)
        if not len(units):
            return [pa.array([], pa.list_(pa.int64()))]
        x = _matrix(units)
        codes = []
        for seed in seeds:
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits)).astype(np.float32)
            side = (x @ planes > 0) if bits else np.zeros((len(x), 0), bool)
            codes.append((side @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64))
        return [pa.array(np.stack(codes, 1).tolist(), pa.list_(pa.int64()))]

    coded = with_columns(nodes, [T.StructField("codes", T.ArrayType(T.LongType()))], make, ["id", "unit"])
    codes = F.concat("codes", F.array(F.pmod(F.xxhash64("id"), F.lit(1 << bits))))
    dealt = coded.select("id", "unit", F.posexplode(codes).alias("tab", "code"))
    sizes = dealt.groupBy("tab", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * s.group)).alias("parts"))
    dealt = dealt.join(sizes, ["tab", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "tab"), "parts"))
    keep = s.neighbours

    def pairs(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        ids = group["id"]
        if len(ids) < 2:
            return None
        x = _matrix(group["unit"])
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        k = min(keep, len(ids) - 1)
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.repeat(ids, k), ids[top.ravel()], np.take_along_axis(sims, top, 1).ravel()

    found = by_group(
        dealt.select("tab", "code", "part", "id", "unit"), ["tab", "code", "part"], "u long, v long, sim float", pairs, ["id"]
    )
    return _best(found.distinct(), keep)


def _around(graph: DataFrame, reverse: int, turn: int) -> DataFrame:
    """(w, m, fresh): each node's neighbours and, of those it is a neighbour of, at most ``reverse``."""
    ahead = graph.select(F.col("u").alias("w"), F.col("v").alias("m"), "fresh")
    order = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("m", "w", F.lit(turn)))
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("m"), "fresh")
    back = back.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= reverse).drop("_n")
    return ahead.unionByName(back).groupBy("w", "m").agg(F.max("fresh").alias("fresh"))


def _round(graph: DataFrame, nodes: DataFrame, s: Settings, turn: int) -> DataFrame:
    """One round: neighbours of a node meet, and those nearer than what a node has are added."""
    bar = graph.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= s.neighbours, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("bar")
    )
    known = nodes.join(bar.withColumnRenamed("u", "id"), "id", "left").select(
        F.col("id").alias("m"), "unit", F.coalesce("bar", F.lit(-2.0).cast("float")).alias("bar")
    )
    met = _around(graph, s.reverse, turn).join(known, "m").select("w", "m", "fresh", "unit", "bar")

    def learn(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        ids, fresh, bar = group["m"], group["fresh"].astype(bool), group["bar"]
        if len(ids) < 2 or not fresh.any():
            return None
        x = _matrix(group["unit"])
        sims = x @ x.T
        wanted = (fresh[:, None] | fresh[None, :]) & (sims > bar[:, None])
        np.fill_diagonal(wanted, False)
        i, j = np.nonzero(wanted)
        return ids[i], ids[j], sims[i, j]

    learnt = by_group(met, ["w"], "u long, v long, sim float", learn, ["m"])
    old = graph.select("u", "v", "sim", F.lit(0).alias("age"))
    every = _best(learnt, s.neighbours).select("u", "v", "sim", F.lit(1).alias("age")).unionByName(old)
    merged = every.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("age").alias("age"))
    return _best(merged, s.neighbours).select("u", "v", "sim", (F.col("age") == 1).alias("fresh"))


@dataclass
class Index:
    """nodes (id, unit); links (w, m); members (id, vec_id, vector): every usable vector and its node."""

    nodes: DataFrame
    links: DataFrame
    members: DataFrame
    settings: Settings


def build(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> Index:
    """Index every usable vector of ``df``. Equal vectors share the node that their hash names.

    Vectors without an id, null, zero, with a null or non-finite component, or of another length than the
    commonest are left out; repeated rows are members of one node. Rounds go on, whatever the size of the
    table, until less than ``delta`` of the links change; links only ever get nearer, so they end.
    """
    s = settings or Settings()
    members = _packed(usable(df, vec_id, vector)).withColumn("id", F.xxhash64("vector"))
    members = stored(members.select("id", "vec_id", "vector", "unit"), "members")
    nodes = stored(members.groupBy("id").agg(F.min("unit").alias("unit")), "nodes")
    members = members.drop("unit")
    graph = stored(_start(nodes, nodes.count(), s).withColumn("fresh", F.lit(True)), "graph")
    for turn in count():
        graph = stored(_round(graph, nodes, s, turn), "graph")
        changed = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if changed is None or changed < s.delta:
            break
    return Index(nodes, stored(_around(graph, s.reverse, -1).select("w", "m"), "links"), members, s)


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, id) with sim, by joins with the vectors of both."""
    both = pairs.join(nodes, "id").join(queries, "q").select("q", "id", "unit", "q_unit")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        sims = np.einsum("ij,ij->i", _matrix(a), _matrix(b)) if len(a) else np.empty(0, np.float32)
        return [pa.array(sims, pa.float32())]

    return with_columns(both, [T.StructField("sim", T.FloatType())], make, ["q", "id"])


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(q, id, sim): up to ``beam`` nodes near each query by greedy search; ``queries`` has q, q_unit and own.

    ``own`` is the node of an indexed query, else null. Searches start there and at the nearest of
    the entry nodes, whose number is a setting and so bounds what is broadcast. They go on until no node
    that is kept is open, and no node is expanded twice for a query.
    """
    s = index.settings

    def kept(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
        return found.withColumn("_n", rank).where(F.col("_n") <= s.beam)

    entries = index.nodes.join(F.broadcast(sample_keys(index.nodes, "id", s.entries)), "id", "left_semi").collect()
    entry_ids = np.array([r["id"] for r in entries], np.int64)
    table = _matrix(np.array([bytes(r["unit"]) for r in entries], object)) if entries else np.empty((0, 1), np.float32)
    take = min(s.beam, len(entry_ids))

    def nearest(batch: pa.RecordBatch) -> list[pa.Array]:
        units = batch.column(batch.schema.get_field_index("q_unit")).to_numpy(zero_copy_only=False)
        if not len(units) or not take:
            return [pa.array([[]] * len(units), pa.list_(pa.int64()))]
        sims = _matrix(units) @ table.T
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        return [pa.array(entry_ids[top].tolist(), pa.list_(pa.int64()))]

    asked = stored(queries, "queries")
    starts = with_columns(asked, [T.StructField("near", T.ArrayType(T.LongType()))], nearest, ["q", "own"])
    first = starts.select("q", F.explode("near").alias("id")).unionByName(
        starts.where("own IS NOT NULL").select("q", F.col("own").alias("id"))
    )
    asked = asked.select("q", "q_unit")
    state = kept(_scored(first.distinct(), asked, index.nodes)).select("q", "id", "sim", F.lit(False).alias("done"), "_n")
    state = stored(state, "search")
    while not state.where("NOT done").isEmpty():
        open_ = state.where("NOT done")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("_n"))
        open_ = open_.withColumn("_o", rank).where(F.col("_o") <= s.expand).select("q", "id")
        seen = state.join(open_.withColumn("_now", F.lit(True)), ["q", "id"], "left")
        seen = seen.select("q", "id", "sim", (F.col("done") | F.coalesce("_now", F.lit(False))).alias("done"))
        near = open_.join(index.links, F.col("id") == F.col("w")).select("q", F.col("m").alias("id")).distinct()
        new = _scored(near.join(state, ["q", "id"], "left_anti"), asked, index.nodes).withColumn("done", F.lit(False))
        state = stored(kept(seen.unionByName(new.select("q", "id", "sim", "done"))), "search")
    return state.select("q", "id", "sim")


def neighbours(index: Index, vec_ids: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each indexed vector of ``vec_ids`` (q), itself left out.

    Scores are cosines of the original vectors in double precision; ties go to the smaller id. Ids
    that repeat in the table count once for each row; asked for, such an id stands for the smallest of its
    vectors, component by component. Of the members of one node the k + 1 smallest
    ids suffice, since they tie.
    """
    own = index.members.join(vec_ids.distinct(), F.col("vec_id") == F.col("q"))
    units = index.nodes.withColumnRenamed("unit", "q_unit")
    asked = own.select("q", F.col("id").alias("own"), F.col("vector").alias("q_vector")).join(
        units, F.col("own") == units["id"]
    )
    least = F.min(F.struct("q_vector", "own", "q_unit")).alias("x")
    asked = stored(asked.groupBy("q").agg(least).select("q", "x.own", "x.q_unit", "x.q_vector"), "asked")
    found = search(index, asked.select("q", "q_unit", "own"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    few = index.members.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n")
    pairs = found.select("q", "id").join(few, "id").join(asked.select("q", "q_vector"), "q").where("vec_id <> q")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("q_vector", "vector"))
        if not len(a):
            return [pa.array([], pa.float64())]
        x, y = (c.flatten().to_numpy().reshape(len(c), -1) for c in (a, b))
        dot = np.einsum("ij,ij->i", x, y)
        return [pa.array(dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)), pa.float64())]

    scored = with_columns(pairs.select("q", "vec_id", "q_vector", "vector"), [T.StructField("score", T.DoubleType())], make, ["q", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
