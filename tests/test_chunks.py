import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.operators import chunks as ck

words = st.text(alphabet="ab. \n!", max_size=160)
relaxed = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def run(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [r.v for r in df.select(column(F.col("text")).alias("v")).collect()]


def pack(parts, size, joiner, oversize):
    """Brute-force greedy packing over a work list, for comparison."""
    closed, open_piece = [], []
    total = lambda: len(joiner.join(open_piece))
    for part in parts:
        if total() + len(part) <= size:
            open_piece.append(part)
            continue
        if open_piece and total():
            closed.append(joiner.join(open_piece))
        open_piece = [part]
        if len(part) > size:
            pieces, keep = oversize(part)
            closed += pieces
            open_piece = keep
    tail = joiner.join(open_piece)
    return closed + ([tail] if tail else [])


def sentences(par, size):
    if len(par) <= size:
        return [par]
    cut = lambda s: ([s[i : i + size] for i in range(0, len(s), size)], [])
    return pack(re.split(r"(?<=[.!?])\s+", par), size, " ", cut)


def chunks(text, size):
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]

    def big(par):
        subs = sentences(par, size)
        return subs[:-1], subs[-1:]

    return pack(paragraphs, size, "\n\n", big)


@relaxed
@given(st.lists(words, min_size=1, max_size=30), st.integers(3, 40))
def test_packing_equals_brute_force(spark, texts, size):
    got = run(spark, lambda c: ck.chunk_array(c, size), texts)
    assert got == [chunks(t, size) for t in texts]


@relaxed
@given(st.lists(words, min_size=1, max_size=30))
def test_budget_is_never_exceeded(spark, texts):
    got = run(spark, lambda c: ck.budget_array(ck.chunk_array(c, 20), 60, 15, 5), texts)
    assert all(sum(map(len, kept)) <= 60 for kept in got)


def test_budget_cuts_the_overflowing_chunk(one):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(ck.budget_array(arr("a" * 50, "a" * 50, " ", "b" * 80, "c"), 120, 60, 30)) == [
        "a" * 50, "b" * 60, "c"
    ]
    assert one(ck.budget_array(arr("a" * 50, "b" * 60, "c" * 60), 120, 60, 5)) == ["a" * 50, "b" * 60, "c" * 10]
    assert one(ck.budget_array(arr("a" * 50, "b" * 60, "c" * 60, "d"), 120, 60, 10)) == ["a" * 50, "b" * 60]


def test_scores_and_top_chunks(spark):
    text = "nothing here\n\nRequirements and skills\n\nBenefits and perks skills\n\nKey responsibilities"
    df = spark.createDataFrame([(1, text), (2, "plain words")], "doc_id long, text string")
    rows = ck.score_chunks(ck.pack_chunks(df, 30)).orderBy("doc_id").collect()
    assert [(s.score, s.pos) for s in rows[0].scored] == [(0, 0), (2, 1), (-3, 2), (2, 3)]
    top = ck.top_chunks(ck.score_chunks(ck.pack_chunks(df, 30)), 2).orderBy("doc_id").collect()
    assert top[0].chunks == ["Requirements and skills", "Key responsibilities"]
    assert top[1].chunks == ["plain words"]


def test_headings(one):
    at = lambda s: one(ck.heading_position(F.lit(s)))
    assert at("intro text here\nKey Skills\nx") == 16
    assert at("KEY SKILLS 2") == 0
    assert at("Key skills\nABC") == -1
    assert at("About Us\nlower line") == -1
    assert at("MixedCase Words\nx" * 2) == -1
    assert at("Élan Vital\nx") == 0
    assert at("A" * 60) == -1


def test_summary(one):
    get = lambda s: one(ck.summary_of(F.lit(s)))
    assert get("Job Summary\nwe build tools\nand ship\nKey Skills\nPython") == "we build tools\nand ship"
    assert get("job summary: inline words") == ": inline words"
    assert get("job summary\nKey Skills\nlower description of it\nrest") == "rest"
    assert get("  plain text ") == "plain text"


def test_chunk_stats_of_blank_text(spark):
    df = spark.createDataFrame([(1, "  "), (2, "skills needed")], "doc_id long, text string")
    a, b = ck.chunk_stats(df).orderBy("doc_id").collect()
    assert (a.original_text_length, a.filtered_text_length, a.number_of_chunks_selected, a.summary) == (0, 0, 0, "")
    assert (b.original_text_length, b.filtered_text_length, b.number_of_chunks_selected) == (13, 13, 1)
    plan = ck.chunk_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_packing_takes_about_linear_time(spark):
    import time

    def took(n):
        pars = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Par one. Two three "), i.cast("string"))), "\n\n")
        long = F.repeat(F.lit("A sentence of some words. "), n)
        df = spark.range(1).select(F.concat(pars, F.lit("\n\n"), long).alias("text"))
        start = time.perf_counter()
        assert ck.pack_chunks(df, 60).select(F.size("chunks").alias("n")).first().n > n // 2
        return time.perf_counter() - start

    took(1000)
    assert took(80_000) < 3 * took(40_000) + 1


def test_packing_many_paragraphs(one):
    words = [f"w{i}" for i in range(1000)]
    got = one(ck.chunk_array(F.col("x"), 10), "x string", ("\n\n".join(words),))
    want, cur = [], ""
    for w in words:
        if len(cur) + len(w) <= 10:
            cur = f"{cur}\n\n{w}" if cur else w
        else:
            want.append(cur)
            cur = w
    assert got == [*want, cur]
