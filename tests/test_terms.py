"""Many terms at once, against looking for one after the other."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from postlake.functions import terms as tm


def test_whole_words(one):
    def tags(text, terms):
        return one(tm.terms_in(F.col("x"), terms), "x string", (text,))

    assert tags("go gopher _go go_ c++ c", ["go", "c++", "c"]) == ["c", "go"]
    assert tags("xc++y", ["c++"]) == [] and tags("c++y", ["c++"]) == ["c++"]
    assert tags("été 日本", ["t", "été", "日", "日本"]) == ["été", "日本"]
    assert tags(None, ["a"]) == [] and tags("a", []) == [] and tags("", ["a", ""]) == []


def test_counts_equal_contains(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choices("abc ", k=rng.randint(1, 4))) for _ in range(60)] + ["", "abc", "abc"]
    groups = (terms[:30], terms[30:], ())
    texts = [None, ""] + ["".join(rng.choices("abcd ", k=30)) for _ in range(200)]
    want = [[0, 0, 0] if t is None else [sum(w in t for w in g) for g in groups] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").coalesce(1)
    assert [r[0] for r in df.select(tm.counts_in(F.col("t"), groups)).collect()] == want
    each = df.select(tm.counts_in_each(F.array("t", "t"), groups)).collect()
    assert [r[0] for r in each] == [[w, w] for w in want]
    assert df.limit(1).select(tm.counts_in_each(F.lit(None).cast("array<string>"), groups)).first()[0] is None


def test_many_terms_cost_about_as_much_as_few():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(6000)]
    text = " ".join(rng.choices(words, k=200_000))

    def took(n):
        terms = tuple(words[:n])
        tm.occurring("x", terms, True)  # the automaton is built once per worker
        start = time.perf_counter()
        found = tm.occurring(text, terms, True)
        assert len(found) == len(set(words[:n]))
        return time.perf_counter() - start

    took(50)
    assert took(5000) < 2 * max(took(50) for _ in range(3)) + 0.15


def test_a_batch_is_worked_in_pieces():
    """Python objects exist for a piece of a batch at a time, whatever the batch holds."""
    import tracemalloc

    column = pa.array([[f"{i} {k} " + "x" * 500 for k in range(8)] for i in range(20 * tm.PIECE)])
    tracemalloc.start()
    got = tm.in_pieces(column, lambda v: [s.upper() for s in v], column.type)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [[s.upper() for s in v] for v in column.to_pylist()]
    assert peak < column.nbytes / 3
    assert tm.in_pieces(column.slice(0, 0), list, column.type).to_pylist() == []
    assert tm.in_pieces(pa.array([None, ["a"]]), lambda v: v, pa.list_(pa.string())).to_pylist() == [None, ["a"]]
