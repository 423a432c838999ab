"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from postlake.llm import ann, bpe, common, langid, mixing, pages, pii, repeats, simhash, sketches, toxicity
from postlake.llm.queries import BPE_RANKS

LONG = "the quick brown fox jumps over " * 20_000
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, None, None, None, None),
    (None, "der hund und die katze", "de", None, 22),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, "write to bob@example.com or +1 (555) 555-0100", "en", "b", 44),
    (6, "漢字 🙂 ", "xx", "c", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path(BPE_RANKS)
#: Names that the operators use themselves.
CLASH = ["score", "fp", "ids", "base", "_ll", "sketch", "h", "key", "path", "_toxic", "probability", "start", "q", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def run_toxicity(df, labels):
    return toxicity.scored(df, toxicity.fit(df, labels)).select("doc_id", "text", "score")


def run_langid(df, labels):
    model = langid.fit(df, "doc_id", "text", "lang", least=1)
    return langid.identify(df, model, declared=F.col("lang"), host=F.col("source"))


OPERATORS = {
    "toxicity": run_toxicity,
    "repeats": lambda df, _: repeats.passages(df),
    "langid": run_langid,
    "sketches": lambda df, _: sketches.compared_with_next(df),
    "mixing": lambda df, _: mixing.weighted(df),
    "mixing_sample": lambda df, _: mixing.sample(df),
    "pii": lambda df, _: pii.find(df, pii.fit(df)),
    "redact": lambda df, _: pii.redact(df, pii.fit(df)),
    "simhash": lambda df, _: simhash.near_components(df),
    "drop_near_copies": lambda df, _: simhash.drop_near_copies(df),
    "bpe": lambda df, _: bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS),
}
#: Rows that come out for the table above.
EXPECTED = {"toxicity": 8, "langid": 8, "sketches": 8, "mixing": 8, "pii": 8, "redact": 8, "simhash": 8, "bpe": 8}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, docs, labels):
    got = OPERATORS[name](docs, labels).collect()
    assert len(got) == EXPECTED.get(name, len(got))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(name, docs, labels):
    clashing = docs.select("*", *[F.lit("?").alias(c) for c in CLASH])
    plain, other = OPERATORS[name](docs, labels), OPERATORS[name](clashing, labels)
    columns = [c for c in plain.columns if c not in CLASH]
    assert sorted(map(str, other.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))


def test_repeated_rows_get_equal_answers(docs, labels):
    for name in ("toxicity", "langid", "sketches", "mixing", "pii", "simhash", "bpe"):
        same = OPERATORS[name](docs, labels).where("doc_id = 1").collect()
        assert len(same) == 2 and same[0] == same[1], name


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (4, "u", "<" * 5000 + "<p " * 5000), (5, "u", "<![foo[bar]]>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df, pages.fit(df), keep=["page_id"]).collect()}
    assert got[1] == got[2] == "" and got[5] == "x" and len(got) == 5
    empty = df.limit(0)
    assert pages.extract(empty, pages.fit(empty)).collect() == []


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(6, None), (7, [None, 1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id IN (0, 3, 6)").select(F.col("vec_id").alias("q"))
    got = ann.neighbours(ann.build(df), asked).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    empty = df.limit(0)
    assert ann.neighbours(ann.build(empty), empty.select(F.col("vec_id").alias("q"))).collect() == []


def test_all_copies_of_one_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f " * 20).alias("text"))
    assert {r.component_id for r in simhash.near_components(df).collect()} == {0}
    assert simhash.drop_near_copies(df).collect()[0].doc_id == 0
    got = repeats.passages(df).agg(F.count("*"), F.min("n_words"), F.max("start_word")).first()
    assert tuple(got) == (3000, 120, 0)


def test_bpe_very_long_texts_and_a_full_store(spark, monkeypatch):
    raw = open(RANKS, "rb").read()
    vocabulary = bpe.Vocabulary(bpe.read_ranks(raw), public_tokenizers.PATTERN)
    texts = ["word %d and " % i * 7 for i in range(300)] + ["a" * 3000, "", " " * 500, "x y " * 3000]
    want = [a.tolist() for a in vocabulary.encode_all(texts)]
    for name, value in (("LONG", 50), ("GROUP", 16), ("STORE", 2000)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.Vocabulary(bpe.read_ranks(raw), public_tokenizers.PATTERN)
    assert [a.tolist() for a in small.encode_all(texts)] == want
    assert [small.decode(ids) for ids in want] == [t.encode() for t in texts]
    tokens = bpe.Runs(small.bytes_of)
    assert [tokens.joined(np.array(ids, np.int64)) for ids in want] == [t.encode() for t in texts]


def test_bpe_digests_equal_encode_then_decode(spark, docs):
    path, pattern = RANKS, public_tokenizers.PATTERN
    two = bpe.decode(bpe.encode(docs, path, pattern), path).select(
        "doc_id", F.size("ids").alias("n"), bpe.ids_digest("ids").alias("i"), F.sha2("decoded", 256).alias("d")
    )
    one = bpe.digests(docs.withColumn("n_tokens", F.lit("?")), path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert bpe.digests(docs.limit(0), path, pattern).collect() == []


def test_samples_bound_rows_not_keys(spark):
    """One id holds a third of the rows, and many labels are junk: what reaches the driver stays bounded."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text number "), (F.col("id") % 20_000).cast("string")).alias("text"),
    )
    got = common.sample_rows(df, "doc_id", "text", 500)
    assert got.count() == 500 == got.distinct().count()
    assert set(common.sample_rows(df.repartition(7), "doc_id", "text", 500).collect()) == set(got.collect())
    hot = common.sample_rows(df.where("doc_id = 7"), "doc_id", "text", 100)
    assert hot.count() == 100
    assert common.sample_rows(df.limit(0), "doc_id", "text", 5).count() == 0
    labels = spark.createDataFrame([(7, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, positives=40, unlabelled=60)
    assert toxicity.scored(df.limit(3), model).count() == 3


def test_junk_labels_make_no_languages(spark):
    df = spark.range(5_000).select(
        F.col("id").alias("doc_id"), F.lit("the cat and the dog").alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.concat(F.lit("label "), F.col("id").cast("string"))).alias("lang"),
    )
    assert langid.fit(df, "doc_id", "text", "lang").languages == ["en"]


def test_redaction_of_many_candidates_takes_about_linear_time(spark, docs):
    import time

    model = pii.fit(docs)

    def took(n):
        text = "call bob at example dot com or 555 0100 22 33, " * n
        start = time.perf_counter()
        model.chosen([text], [pii.base_spans(text)])
        return time.perf_counter() - start

    took(100)
    assert took(4000) < 3 * took(2000) + 0.5


def test_examples_are_bounded(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a@b.co +1 555 555 0100 1.2.3.4 " * 40).alias("text"))
    assert pii.find(df, pii.fit(df, most=50)).count() == 60


def test_a_repeated_vector_id_asks_with_its_smallest_vector(spark):
    rows = [(0, [0.0, 1.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5])]
    clash = ["q", "id", "unit", "sim", "rank", "score", "_h", "w", "m"]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").select("*", *[F.lit("?").alias(c) for c in clash])
        got = ann.neighbours(ann.build(df), spark.createDataFrame([(0,)], "q long")).orderBy("rank").collect()
        assert [(r.vec_id, round(r.score, 3)) for r in got] == [(1, 1.0), (3, 0.447), (2, 0.0)]
