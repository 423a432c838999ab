"""SimHash near-duplicate groups, searched with BK-trees.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so
each fingerprint goes to one shard per block, keyed by that block's bits. A shard becomes a BK-tree
in the task that the shuffle sends it to; nothing that grows with the corpus is broadcast. A shard
with more than ``SHARD`` fingerprints is divided by the same rule over its remaining bits, and one
that is still too large is searched in blocks of two slices, so that no task holds a group without
a bound. A shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import by_group, stored, text_of, texts_in, with_columns
from postlake.llm.graph import components

#: Fingerprints of a shard that one tree may hold.
SHARD = 1024
_BLOCK = 65_536  # shingles counted at a time


def fingerprint(text: str, width: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """A 64-bit SimHash per seed of a text's word shingles (A-Z lower-cased, repeats included); no word: 0."""
    words = _words(text)
    if not words:
        return [0] * len(seeds)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    found = []
    for seed in seeds:
        counts = np.zeros(64, np.int64)
        for at in range(0, len(shingles), _BLOCK):
            hashes = np.array([digest(s, seed) for s in shingles[at : at + _BLOCK]], "<u8")
            bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        found.append(int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0]))
    return found


def fingerprints(
    df: DataFrame,
    text: str = "text",
    into: dict[str, int] | None = None,
    width: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add fingerprints as longs that hold the 64 bits; ``into`` maps new columns to seeds (default: fp, 42).

    A null text has the fingerprint of the empty text.
    """
    into = into or {"fp": 42}

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprint(t, width, tuple(into.values())) for t in texts_in(batch, text)]
        table = np.array(found, np.uint64).reshape(-1, len(into)).view(np.int64)
        return [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(into))]

    return with_columns(df, [T.StructField(c, T.LongType()) for c in into], make, keep)


class BKTree:
    """Values of 64 bits; each child hangs on its parent by the Hamming distance between them."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            group = todo.pop()
            root, rest = group[0], group[1:]
            if not len(rest):
                continue
            apart = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(apart, kind="stable")
            rest, apart = rest[order], apart[order]
            cuts = np.flatnonzero(np.diff(apart)) + 1
            for part in np.split(np.arange(len(rest)), cuts):
                self.children[root].append((int(apart[part[0]]), int(rest[part[0]])))
                todo.append(rest[part])

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within ``radius`` of it), following only edges within the radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, asked = todo.pop()
            apart = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int16)
            found = asked[apart <= radius]
            if len(found):
                yield node, found
            for edge, child in self.children[node]:
                on = asked[np.abs(apart - edge) <= radius]
                if len(on):
                    todo.append((child, on))


def _roots(size: int, pairs: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The first position of each position's group, and those of the pairs that joined two groups."""
    parent, joined = np.arange(size), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            joined.append((x, y))
    return np.array([root(i) for i in range(size)], np.int64), joined


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the position of its group's first value, over links within the radius."""
    links = ((node, int(other)) for node, found in BKTree(values).search(values, radius) for other in found)
    return _roots(len(values), links)[0]


def nearest_forest(values: np.ndarray, check: np.ndarray, radius: int, check_radius: int) -> np.ndarray:
    """Pairs of positions that connect the groups within the radii, of all such pairs the nearest ones."""
    left, right = [], []
    for node, found in BKTree(values).search(values, radius):
        found = found[found > node]
        left.append(np.full(len(found), node))
        right.append(found)
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
    apart = np.bitwise_count(check[x] ^ check[y]).astype(np.int16)
    on = apart <= check_radius
    x, y, apart = x[on], y[on], apart[on] + np.bitwise_count(values[x[on]] ^ values[y[on]])
    order = np.lexsort((y, x, apart))
    _, joined = _roots(len(values), list(zip(x[order].tolist(), y[order].tolist())))
    return np.array(joined, np.int64).reshape(-1, 2)


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _shards(df: DataFrame, radius: int) -> DataFrame:
    """One row per fingerprint and block: (path, shard, block, fp, ...)."""
    masks = [_signed(b) for b in _cut(list(range(64)), radius + 1)]
    keys = F.array(
        *[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(masks)]
    )
    return df.select(F.explode(keys).alias("_k"), *df.columns).select("_k.*", *df.columns)


def _divided(df: DataFrame, radius: int) -> DataFrame:
    """Rows of large shards, dealt out again by the bits that their shard has not fixed."""
    parts = radius + 1
    masks = []
    for i, first in enumerate(_cut(list(range(64)), parts)):
        left = [b for b in range(64) if b not in first]
        masks.append([_signed(sorted(first + b)) for b in _cut(left, parts)])
    rows = F.array(*[F.array(*[F.lit(m) for m in row]) for row in masks])
    keys = F.transform(
        F.element_at(rows, F.col("path") + 1),
        lambda m, i: F.struct(
            (F.lit(parts) + F.col("path") * parts + i).cast("int").alias("path"), F.col("fp").bitwiseAND(m).alias("shard")
        ),
    )
    columns = [c for c in df.columns if c not in ("path", "shard", "size")]
    return df.select(F.explode(keys).alias("_k"), *columns).select("_k.*", *columns)


def _sized(df: DataFrame) -> DataFrame:
    """Rows of shards of two or more fingerprints, with the shard's size."""
    sizes = df.groupBy("path", "shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return df.join(sizes, ["path", "shard"])


def _in_blocks(df: DataFrame, bound: int) -> DataFrame:
    """Large shards cut into slices of about half of ``bound``; each two slices meet in one block."""
    slices = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(bound // 2))).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("_slices") - 1),
        lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), F.greatest(j, F.col("_own")).alias("j")),
    )
    kept = [c for c in df.columns if c != "size"]
    return (
        df.withColumns({"_slices": slices, "_own": own})
        .select(*kept, F.explode(others).alias("_b"))
        .select(*kept, (F.col("_b.i").cast("long") * (1 << 31) + F.col("_b.j")).alias("block"))
    )


def _search(df: DataFrame, radius: int, check_radius: int | None) -> DataFrame:
    """Forest links (a, b) of every (path, shard, block); with a second fingerprint also (a_check, b_check)."""
    order = ["path", "shard", "block"]

    def links(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        fp = group["fp"]
        if len(fp) < 2:
            return None
        of = forest(fp.view(np.uint64), radius)
        on = of != np.arange(len(of))
        return fp[of[on]], fp[on]

    def checked(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        fp, check = group["fp"], group["check"]
        if len(fp) < 2:
            return None
        x, y = nearest_forest(fp.view(np.uint64), check.view(np.uint64), radius, check_radius or 0).T
        return fp[x], fp[y], check[x], check[y]

    if check_radius is None:
        return by_group(df.select(*order, "fp"), order, "a long, b long", links, ["fp"])
    rows = df.select(*order, "fp", "check")
    return by_group(rows, order, "a long, b long, a_check long, b_check long", checked, ["fp", "check"])


def near_links(fps: DataFrame, radius: int, check_radius: int | None = None, bound: int = SHARD) -> DataFrame:
    """Links (a, b) that connect exactly the groups of fingerprints within ``radius`` bits.

    ``fps`` has distinct rows (fp), or (fp, check) with ``check_radius``: then a link also needs at most so
    many differing bits of the second fingerprint, each shard reports its nearest links, and they
    carry the second fingerprints as well.
    """
    first = stored(_sized(_shards(fps, radius)), "shards")
    small = first.where(F.col("size") <= bound).drop("size").withColumn("block", F.lit(0).cast("long"))
    large = first.where(F.col("size") > bound)
    if not large.isEmpty():
        small = small.unionByName(_in_blocks(_sized(_divided(large, radius)), bound))
    return _search(small, radius, check_radius)


def near_groups(docs: DataFrame, radius: int = 2, bound: int = SHARD) -> DataFrame:
    """For each distinct fingerprint of ``docs`` (doc_id, fp): (fp, root, component_id).

    ``component_id`` is the smallest doc_id of all documents that chains of links reach; null if
    none of them has a doc_id. ``root`` is the component's smallest fingerprint and never null.
    """
    texts = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    label = components(near_links(texts.select("fp"), radius, bound=bound))
    named = texts.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come
    out as often as they go in. A null doc_id never names a component. An empty table gives no rows.
    """
    rows = stored(
        fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width, keep=["doc_id"]),
        "documents",
    )
    return rows.join(near_groups(rows, radius), "fp", "left").select("doc_id", "fp", "component_id")


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def resemblance(one: str, other: str, width: int = 5) -> float:
    """Share of common word shingles; a text of fewer words is one shingle, and so is an empty text."""

    def shingles(text: str) -> set[bytes]:
        words = _words(text)
        return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}

    a, b = shingles(one), shingles(other)
    return len(a & b) / len(a | b)


def _alike(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """Of pairs (a, b) of text hashes those whose texts (t, text) resemble each other so much."""
    sides = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("_one")), "a").join(
        texts.select(F.col("t").alias("b"), F.col("text").alias("_other")), "b"
    )

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        both = zip(texts_in(batch, "_one"), texts_in(batch, "_other"))
        return [pa.array([resemblance(x, y, width) >= least for x, y in both], pa.bool_())]

    judged = with_columns(sides, [T.StructField("alike", T.BooleanType())], make, ["a", "b"])
    return judged.where("alike").select("a", "b")


def drop_near_copies(
    df: DataFrame,
    radius: int = 6,
    check_radius: int = 16,
    least: float = 0.8,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id (of equal ones, one row).

    Candidates are texts that have two fingerprints of three-word shingles, of different seeds, of which
    one differs in at most ``radius`` bits and the other in at most ``check_radius``. A shard proposes the nearest pairs that
    connect its candidates, and a pair is a link if the texts themselves share at least ``least`` of
    their ``width``-word shingles. Groups are what chains of links reach, so a document goes only for
    one that it is linked to. Null texts are empty ones. Documents without a doc_id go only for a near
    copy of theirs; of repeated rows one stays. All columns of ``df`` stay as they are.
    """
    whole = text_of(df[text])
    rows = df.select(F.col(doc_id).alias("doc_id"), whole.alias("text"))
    hashed = F.xxhash64("text").alias("t")
    marked = fingerprints(rows.select("doc_id", "text", hashed), into={"fp": 42, "check": 43}, keep=["doc_id", "t"])
    marked = stored(marked, "documents")
    nodes = stored(marked.groupBy("fp", "check").agg(F.min("t").alias("t")), "fingerprints")
    # Texts with both fingerprints equal hang on one of them.
    first = nodes.withColumnRenamed("t", "b")
    same = marked.join(first, ["fp", "check"]).where("t <> b").select(F.col("t").alias("a"), "b")
    at = lambda side: nodes.select(F.col("fp").alias(side), F.col("check").alias(f"{side}_check"), F.col("t").alias(f"t{side}"))
    turned = nodes.select(F.col("check").alias("fp"), F.col("fp").alias("check"))
    found = near_links(nodes.select("fp", "check"), radius, check_radius).unionByName(
        near_links(turned, radius, check_radius).select(
            F.col("a_check").alias("a"), F.col("b_check").alias("b"), F.col("a").alias("a_check"), F.col("b").alias("b_check")
        )
    ).distinct()
    near = found.join(at("a"), ["a", "a_check"]).join(at("b"), ["b", "b_check"])
    near = near.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b"))
    pairs = stored(same.unionByName(near).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    texts = rows.select("text", hashed).join(asked, "t", "left_semi").dropDuplicates(["t"])
    label = components(_alike(pairs, stored(texts, "texts"), least, width))
    named = marked.join(label.select(F.col("node").alias("t"), "root"), "t", "left")
    best = named.groupBy(F.coalesce("root", "t").alias("root")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "t")).alias("_one")
    )
    # One key for id and text, so that the documents are dealt out once.
    key = lambda i, t: [F.xxhash64(F.lit(salt), i.cast("string"), i.isNull(), t).alias(f"_llm_{salt}") for salt in (1, 2)]
    names = ["_llm_1", "_llm_2"]
    kept = best.select(*key(F.col("_one.doc_id"), F.col("_one.t")))
    full = df.select("*", *key(df[doc_id], F.xxhash64(whole)))
    return full.join(kept, names, "left_semi").dropDuplicates(names).select(*[df[c] for c in df.columns])


def hex_digits(fp: str | Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    column = F.col(fp) if isinstance(fp, str) else fp
    return F.lower(F.lpad(F.hex(column), 16, "0"))
