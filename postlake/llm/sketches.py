"""Bottom-k sketches of shingle hashes as documents' fingerprints, in DataFrame operations only.

A sketch is the sorted array of the k smallest distinct hashes of a text's word shingles. Sketches
of parts merge into the sketch of the whole, and estimate resemblance, containment and the number
of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import stored, text_of

#: Hashes kept, and words in a shingle.
K, WIDTH = 128, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, although the body names it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Sketch of a text's shingles of lower-cased words between white space.

    A text of fewer words than ``width`` is one shingle; one without words has an empty sketch.
    """
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    word_hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])
        )
        few = F.array(F.xxhash64(h))
        none = F.slice(h, 1, 0)
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, few).otherwise(none)

    return smallest(let(word_hashes, shingles), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched texts' shingles."""
    return smallest(F.concat(a, b), k)


def merge_by(df: DataFrame, key: str, sketches: str, k: int = K) -> DataFrame:
    """(key, sketch): the sketch of each group from the sketches of its parts.

    Parts are first merged within slices by hash, so that a group with very many parts meets no
    single task before each slice has shrunk to k hashes.
    """
    spread = df.select(key, F.explode(sketches).alias("h"))
    for keys in ([key, "_slice"], [key]):
        if "_slice" in keys:
            spread = spread.withColumn("_slice", F.pmod("h", F.lit(64)))
        order = Window.partitionBy(*keys).orderBy("h")
        spread = spread.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return spread.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketches))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of common shingles among all, 0 to 1; 1 for two empty sketches."""
    return let(
        F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("c")),
        lambda x: F.when(F.size(x["u"]) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(x["u"], x["c"])) / F.size(x["u"])
        ),
    )


def n_distinct(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = F.element_at(a, -1) / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too; 1 if a has none."""
    both = resemblance(a, b, k) * n_distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / n_distinct(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: its hashes in decimal, joined by commas."""
    return F.array_join(a.cast("array<string>"), ",")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that name a row by its id and text; neither is ever null."""
    text = text_of("text")
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"),
        F.xxhash64(text).alias("h"),
    )


def successors(keys: DataFrame) -> DataFrame:
    """Adds next_key and next_h to (doc_id, key, h, ...): the follower by descending doc_id, then h.

    The first follows the last. Keys are dealt out by ranges. Followers are found within a range,
    and for the last of each range among the first keys of the ranges, one row a partition.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("key")]
    ranged = keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    within = Window.partitionBy("part").orderBy(*order)
    here = F.struct("key", "h")
    numbered = ranged.withColumns({"_n": F.row_number().over(within), "_next": F.lead(here).over(within)})
    firsts = numbered.where("_n = 1").select("part", here.alias("first"))
    across = Window.orderBy("part")
    start = F.first("first").over(across.rowsBetween(Window.unboundedPreceding, 0))
    heads = firsts.select("part", F.coalesce(F.lead("first").over(across), start).alias("_head"))
    to = F.coalesce("_next", "_head")
    return numbered.join(heads, "part").select(*keys.columns, to["key"].alias("next_key"), to["h"].alias("next_h"))


def compared_with_next(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited text and sketches of every text, of its edited text and of the next one.

    The edited text has its last third (rounded down, in code points) replaced by as many code points
    from the start of the next document by descending doc_id. Null texts are empty. Rows of one
    doc_id are ordered by their text's hash; repeated rows count as one document and get equal rows.
    Null ids come last. A single document follows itself; an empty table gives no rows.

    Texts are shuffled once, by key: the same exchange serves the rows and what they lend to the
    document before them, which goes as a prefix and a sketch.
    """
    rows = _keyed(docs)
    keys = rows.select("doc_id", "key", "h", (F.length("text") / 3).cast("int").alias("cut"))
    follows = stored(successors(keys), "followers")
    wanted = follows.select(
        F.col("next_key").alias("key"), F.col("next_h").alias("h"), F.col("key").alias("to_key"), F.col("h").alias("to_h"), "cut"
    )
    lent = rows.join(wanted, ["key", "h"]).select(
        F.col("to_key").alias("key"),
        F.col("to_h").alias("h"),
        F.col("doc_id").alias("next_id"),
        F.expr("left(text, cut)").alias("lent"),
        sketch(F.col("text"), k, width).alias("next_sketch"),
    )
    one = Window.partitionBy("key", "h").orderBy("next_id")
    lent = lent.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - (n / 3).cast("int")), F.col("lent"))
    return (
        rows.join(lent, ["key", "h"])
        .select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_id", "next_sketch")
        .withColumn("sketch", sketch(F.col("text"), k, width))
        .withColumn("edited_sketch", sketch(F.col("edited"), k, width))
        .drop("text")
    )
