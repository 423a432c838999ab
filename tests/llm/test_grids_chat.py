"""Integer clustering, vector codes and chat formatting against plain definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import centroids, chat, codes
from postlake.llm.grid import squared

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, points):
    far = ((rows[:, None, :] - points[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


def clustered(seed, n, dims, centres, spread=30):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-200, 200, (centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.integers(-spread, spread + 1, (n, dims))


# n-simplex projection


@pytest.mark.parametrize("dims,pivots", [(1, 8), (2, 3), (5, 8), (64, 8), (64, 1)])
def test_simplex_bounds_hold(dims, pivots):
    rows, others = clustered(1, 300, dims, 5), clustered(2, 40, dims, 5)
    simplex = centroids.Simplex(others, pivots)
    assert len(simplex.pivots) <= min(pivots, dims + 1)
    low, high = simplex.bounds(simplex.distances(rows), simplex.distances(others))
    exact = ((rows[:, None, :] - others[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()


def test_simplex_reproduces_the_pivots_distances():
    points = clustered(3, 50, 16, 4)
    simplex = centroids.Simplex(points, 6)
    apexes = simplex.apexes(simplex.distances(points))
    full = np.pad(simplex.vertices, ((0, 0), (0, 1)))
    for j in range(len(simplex.pivots)):
        assert np.allclose(((apexes - full[j]) ** 2).sum(1), simplex.distances(points)[:, j], rtol=1e-6, atol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_nearest_centroid_is_exact_and_filtered(seed):
    rows, points = clustered(seed, 2000, 64, 12), clustered(seed, 40, 64, 12)
    points[7] = points[3]  # a tie goes to the smaller number
    simplex = centroids.Simplex(points)
    found, best, compared = centroids.nearest(rows, points, simplex, simplex.distances(rows))
    want, far = brute(rows, points)
    assert (found == want).all() and (best == far).all() and 7 not in found
    assert compared < 0.5 * rows.shape[0] * len(points)


def test_equal_points_make_one_pivot():
    points = np.full((40, 64), 5)
    simplex = centroids.Simplex(points)
    found, best, _ = centroids.nearest(points, points, simplex, simplex.distances(points))
    assert len(simplex.pivots) == 1 and not found.any() and not best.any()


def plain_clusters(rows, k, rounds, scale):
    """rows: (key, vector) with whole vectors."""
    whole = [(key, [int(np.floor(scale * x)) for x in v]) for key, v in rows]
    first = sorted(whole, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    points, data = [v for _, v in first], [v for _, v in whole]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(points)), key=lambda c: (dist(v, points[c]), c))
    for _ in range(rounds):
        of = [near(v) for v in data]
        points = [
            [sum(col) // len(own) for col in zip(*own)] if (own := [v for v, a in zip(data, of) if a == c]) else points[c]
            for c in range(len(points))
        ]
    return [(key, near(v), dist(v, points[near(v)])) for key, v in whole], points


ODD = [
    (0, [0.5, -0.25, 0.125, 1.0], 1),
    (0, [0.5, -0.25, 0.125, 1.0], 1),
    (1, None, 1),
    (2, [], None),
    (3, [float("nan"), 0.0, 0.0, 0.0], 2),
    (4, [float("inf"), 0.0, 0.0, 0.0], 2),
    (5, [None, 0.0, 0.0, 0.0], 2),
    (6, [1.0, 2.0, 3.0], 2),
    (None, [0.25, 0.25, -1e-9, 0.0], None),
    (7, [0.0, 0.0, 0.0, 0.0], None),
    (8, [-0.001, 0.7, -0.7, 0.001], 2),
]


def odd_vectors(spark):
    rng = random.Random(5)
    more = [(i, [rng.choice((-0.5, 0.0, 0.5)) + rng.random() / 9 for _ in range(4)], i % 3 or None) for i in range(10, 90)]
    rows = ODD + more + more[:20]
    whole = [(k, v) for k, v, _ in rows if v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    return spark.createDataFrame(rows, VECTORS), whole, rows


def test_clusters_equal_plain_ones(spark):
    df, whole, _ = odd_vectors(spark)
    assigned, points = centroids.cluster(df, k=7, rounds=3, dims=4, pivots=3)
    want, plain = plain_clusters(whole, 7, 3, 256)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, assigned.collect()), key=order) == sorted(want, key=order)
    assert points.tolist() == plain
    facts = centroids.with_inertia(assigned, points).collect()
    for r in facts:
        assert r.inertia == sum(d for *_, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_centroids_and_far_components(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [-1e300, 0.0], 0), (3, [3.0, 0.0], 0)], VECTORS)
    assigned, points = centroids.cluster(df, dims=2)
    assert len(points) == 3 and {r.distance for r in assigned.collect()} == {0}
    assert points[:, 0].max() == 2**27


@pytest.mark.parametrize("run", ["cluster", "compress"])
def test_vectors_empty_and_clashing(spark, run):
    df, _, _ = odd_vectors(spark)
    work = {
        "cluster": lambda d: centroids.with_inertia(*centroids.cluster(d, k=5, dims=4)),
        "compress": lambda d: codes.with_label_error(codes.compress(d, keep=["label"], size=16, dims=4, parts=2)[0]),
    }[run]
    assert work(df.limit(0)).collect() == []
    clash = ["_ints", "_far", "_hash", "cluster", "distance", "codes", "error", "n", "total", "inertia", "label_error"]
    other = work(df.select("*", *[F.lit("?").alias(c) for c in clash]))
    assert sorted(map(str, other.collect())) == sorted(map(str, work(df).collect()))


# GNAT


@pytest.mark.parametrize("n", [0, 1, 3, 8, 9, 60, 256])
def test_gnat_equals_brute_force(n):
    entries, queries = clustered(n, n, 16, 6), clustered(n + 1, 700, 16, 6)
    if n >= 9:
        entries[5] = entries[2]
        queries[:n] = entries  # distance 0, ties included
    found, best, _ = codes.Gnat(entries).nearest(queries if n else queries[:0])
    if n:
        want, far = brute(queries, entries)
        assert (found == want).all() and (best == far).all()


def test_gnat_ties_go_to_the_first_entry():
    entries = np.array([[2, 0], [0, 2], [-2, 0], [0, -2]] * 20)
    found, best, _ = codes.Gnat(entries).nearest(np.zeros((3, 2), np.int64))
    assert found.tolist() == [0, 0, 0] and best.tolist() == [4, 4, 4]


def test_gnat_drops_subtrees():
    entries, queries = clustered(1, 256, 16, 20), clustered(1, 1000, 16, 20)
    _, _, measured = codes.Gnat(entries).nearest(queries)
    assert measured < 0.6 * 256 * 1000


def test_roots_enclose():
    squares = np.array([0, 1, 2, 10**12 + 1, 2**62, 2**53 + 1])
    low, high = codes._root_down(squares), codes._root_up(squares)
    for s, a, b in zip(squares.tolist(), low.tolist(), high.tolist()):
        assert a == 0 or (int(a * 2**20) ** 2 <= s * 2**40)
        assert b * b >= s


def plain_codes(rows, parts, size, rounds, scale):
    whole = [(key, [int(np.floor(scale * x)) for x in v]) for key, v in rows]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books, error, out = [], [0] * len(whole), [[] for _ in whole]
    for p in range(parts):
        book, data = [cut(v, p) for _, v in first], [cut(v, p) for _, v in whole]
        near = lambda v: min(range(len(book)), key=lambda c: (dist(v, book[c]), c))  # noqa: B023, E731
        for _ in range(rounds):
            of = [near(v) for v in data]
            book = [
                [sum(x) // len(own) for x in zip(*own)] if (own := [v for v, a in zip(data, of) if a == c]) else book[c]
                for c in range(len(book))
            ]
        for i, v in enumerate(data):
            out[i].append(near(v))
            error[i] += dist(v, book[near(v)])
        books.append(book)
    return [(key, tuple(c), e) for (key, _), c, e in zip(whole, out, error)], books


def test_codes_equal_plain_ones(spark):
    df, whole, rows = odd_vectors(spark)
    coded, books = codes.compress(df, keep=["label"], size=32, rounds=3, dims=4, parts=2)
    want, plain = plain_codes(whole, 2, 32, 3, 1024)
    got = codes.with_label_error(coded).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, tuple(r.codes), r.error) for r in got), key=order) == sorted(want, key=order)
    assert [b.tolist() for b in books] == plain
    for label in {r.label for r in got}:
        of = [r for r in got if r.label == label]
        assert {r.label_error for r in of} == {sum(r.error for r in of)}
    assert codes.decompress(got[0].codes, books).tolist() == plain[0][got[0].codes[0]] + plain[1][got[0].codes[1]]
    flat = ",".join(str(x) for b in plain for entry in b for x in entry)
    assert codes.books_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_parts_must_divide():
    with pytest.raises(ValueError):
        codes.compress(None, dims=10, parts=4)


# chat formatting

PIECES = ["<", "\\", "|", "im_end", "im_start", "|>", "<|im_end|>", "<|im_start|>", "\n", "a", "nl", "<|nl|>", "<\\|", "é🙂", "ok"]


def plain_parse(formatted):
    back = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    turns = []
    while formatted:
        assert formatted.startswith(chat.START)
        body, formatted = formatted[len(chat.START) :].split(chat.END + "\n", 1)
        role, text = body.split("\n", 1)
        turns.append((back(role.replace(chat.LINE, "\n")), back(text)))
    return turns


def formatted(df):
    return chat.conversations(df).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask")))


def test_chat_round_trip(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices(PIECES, k=rng.randint(0, n)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", text(3)]), text(9)) for c in range(400) for t in range(rng.randint(1, 4))]
    source = {}
    for c, _, role, words in rows:
        source.setdefault(c, []).append((role, words))
    levels = set()
    for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert plain_parse(r.formatted) == [tuple(t) for t in r.read] == source[r.conv_id]
        assert r.identical and r.loss == [words for role, words in source[r.conv_id] if role == "assistant"]
        at, learned = 0, []
        for run in r["mask"]:
            learned += [plain_unescaped(r.formatted[at : at + run.chars])] if run.learned else []
            at += run.chars
        assert at == len(r.formatted) and learned == r.loss
        levels |= {t.level for t in r.turns}
    assert levels == {chat.PLAIN, chat.CONFLICTS}


def plain_unescaped(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def test_chat_escapes_only_conflicts(spark):
    rows = [(1, 0, "user", "a <|x|> b"), (1, 1, "user", "a <|im_end|> <|x|> b"), (1, 2, "user", "<\\|")]
    got = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == (
        "<|im_start|>user\na <|x|> b<|im_end|>\n"
        "<|im_start|>user\na <\\|im_end|> <|x|> b<|im_end|>\n"
        "<|im_start|>user\n<\\\\|<|im_end|>\n"
    )


def test_chat_all_level_reads_back(spark, one):
    text = "<| <\\| <|im_end|> <|nl|>"
    schema, row = "role string, text string", ("a\n<|nl|>", text)
    for level in (chat.CONFLICTS, chat.ALL):
        found = one(chat.parse(chat.rendered(F.col("role"), F.col("text"), level)), schema, row)
        assert [tuple(t) for t in found] == [row]


@pytest.mark.parametrize("word", ["x", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na", "<|im_start|>u\n<|im_start|><|im_end|>\n"])
def test_not_in_the_grammar(one, word):
    assert one(chat.parse(F.col("x")), "x string", (word,)) is None


def test_chat_odd_rows(spark):
    long = "<|im_end|>" * 50_000
    rows = [(1, 1, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, "assistant", "first"), (None, 0, "assistant", long)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in formatted(df).collect()}
    assert [tuple(t) for t in got[1].read] == [("assistant", "first"), ("user", "same"), ("user", "same"), ("", "")]
    assert got[None].loss == [long] and all(r.identical for r in got.values())
    assert formatted(df.limit(0)).collect() == []
    clash = ["turns", "formatted", "mask", "read", "identical", "_role", "_text", "_turn", "_level", "_written"]
    other = formatted(df.select("*", *[F.lit("?").alias(c) for c in clash]))
    assert sorted(map(str, other.collect())) == sorted(map(str, got.values()))


def test_one_conversation_of_many_turns(spark):
    df = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("a <|im_end|> b").alias("text")
    )
    got = formatted(df).select("identical", F.size("loss").alias("n"), F.size("mask").alias("runs")).first()
    assert tuple(got) == (True, 30_000, 90_000)


def test_squared_is_exact():
    assert squared(np.array([[2**27, -(2**27)]]), np.array([-(2**27), 2**27])).tolist() == [2**57]
