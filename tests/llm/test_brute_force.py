"""Operators against plain definitions on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from postlake.llm import ann, bpe, langid, mixing, pages, pii, queries, repeats, simhash, sketches, toxicity
from postlake.llm.boosting import BoostedTrees
from postlake.llm.graph import components
from tests.conftest import DATA

RAW = open(public_tokenizers.path(queries.BPE_RANKS), "rb").read()
VOCABULARY = bpe.Vocabulary(bpe.read_ranks(RAW), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())},
    special_tokens={},
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst  \n\t'.,!0123éñ漢🙂\x1c\x85"), max_size=60))
def test_bpe_equals_library(text):
    assert VOCABULARY.encode(text) == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(VOCABULARY.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bpe_edits_are_exact(data):
    letters = st.text(alphabet=st.sampled_from("abdegint  '\n1é"), max_size=50)
    text, new = data.draw(letters), data.draw(letters)
    start = data.draw(st.integers(0, len(text)))
    end = data.draw(st.integers(start, len(text)))
    held = bpe.EncodedText(VOCABULARY, text)
    held.replace(start, end, new)
    assert held.text == text[:start] + new + text[end:]
    assert held.ids() == LIBRARY.encode_ordinary(held.text)
    held.append(new)
    assert held.ids() == LIBRARY.encode_ordinary(held.text)


def test_bpe_prefix_table_edits_cost_what_is_near():
    data = b"theinformationofthething" * 100
    table = bpe.PrefixTable(VOCABULARY, data)
    done = table.replace(50, 52, b"xyz")
    assert table.ids() == VOCABULARY.merged(data[:50] + b"xyz" + data[52:])
    assert done < 400
    table.append(b"ation")
    assert table.ids() == VOCABULARY.merged(table.data)


def test_bpe_query(spark, texts):
    for r in queries.QUERIES["op10_byte_bpe"](spark, DATA).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# SimHash


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_query(spark, texts):
    want = {d: plain_fingerprint(t) for d, t in texts.items()}
    near = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    group = groups_of(near, want)
    got = queries.QUERIES["op9_simhash_near_dedup"](spark, DATA).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", group[d]) for d, f in want.items()}


@pytest.mark.parametrize(("radius", "bound"), [(2, 1024), (2, 16), (3, 8), (7, 32)])
def test_links_connect_what_is_near(spark, radius, bound):
    """Clusters with many distinct values, so that shards outgrow their bound and are divided."""
    rnd = random.Random(radius)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = rnd.getrandbits(64)
        values |= {centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) % (1 << 64) for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(fps, radius, bound=bound).collect()]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(a != b for a, b in links)
    want = groups_of([(a, b) for a in signed for b in signed if a < b and far(a, b) <= radius], signed)
    assert groups_of(links, signed) == want


def test_bk_tree_follows_only_near_edges():
    rnd = np.random.default_rng(0)
    values = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    tree = simhash.BKTree(values)
    found = {(n, int(q)) for n, qs in tree.search(values[:50], 20) for q in qs}
    assert found == {(n, q) for q in range(50) for n in range(500) if int(values[n] ^ values[q]).bit_count() <= 20}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    n = 300
    rnd = random.Random(1)
    order = rnd.sample(range(n), n)
    links = {
        "chain": list(zip(order, order[1:])),
        "star": [(order[0], x) for x in order[1:]],
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(200)],
    }[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups_of(links, range(n))
    assert got == {x: want[x] for pair in links for x in pair if pair[0] != pair[1]} | {
        k: v for k, v in got.items() if k == v == want[k]
    }


def test_near_copies_go_and_clean_documents_stay(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    clean = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(60)]
    rows = list(enumerate(clean))
    for i in range(20):
        parts = clean[i].split()
        parts[rnd.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(parts)))
        rows.append((200 + i, clean[i]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert set(range(60)) <= kept and not any(d >= 200 for d in kept)
    assert sum(100 <= d < 200 for d in kept) <= 1


def test_near_copy_stage_against_all_pairs(spark, docs, texts):
    """Every document that goes has a partner that shares 0.8 of its shingles, and no pair at 0.85 stays."""
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    ids = sorted(texts)
    near = {i: set() for i in ids}
    shingles = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for i, t in texts.items()}
    share = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (likeness := share(a, b)) >= 0.8:
                near[a].add(b)
                near[b].add(a)
                assert likeness < 0.85 or not {a, b} <= kept
    assert all(near[i] for i in ids if i not in kept) and len(kept) < len(ids)


def test_resemblance():
    assert simhash.resemblance("a b c d e f", "A b c d e f") == 1 and simhash.resemblance("", "") == 1
    assert simhash.resemblance("a b c d e f", "a b c d e g") == 1 / 3 and simhash.resemblance("a", "b") == 0


def test_nearest_forest_joins_the_nearest_first():
    fp, check = np.array([0, 1, 3, 7], np.uint64), np.array([0, 0, 0, 0], np.uint64)
    assert sorted(map(tuple, simhash.nearest_forest(fp, check, 3, 64).tolist())) == [(0, 1), (1, 2), (2, 3)]
    two = simhash.nearest_forest(fp, np.array([0, 255, 0, 255], np.uint64), 3, 4)
    assert sorted(map(tuple, two.tolist())) == [(0, 2), (1, 3)]
    assert len(simhash.nearest_forest(fp, np.array([0, 255, 65280, 16711680], np.uint64), 3, 4)) == 0


def test_unlike_documents_without_ids_stay(spark):
    rnd = random.Random(5)
    clean = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200)) for _ in range(12)]
    rows = [(None, t) for t in clean] + [(None, clean[0]), (7, clean[1]), (8, clean[1])]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(clean)
    assert [r.doc_id for r in kept if r.doc_id is not None] == [7]


# bottom-k sketches


def test_sketch_query(spark, texts):
    ids = sorted(texts, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    near = []
    for r in queries.QUERIES["op6_fingerprints"](spark, DATA).collect():
        text, other = texts[r.doc_id], texts[follows[r.doc_id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert (r.n_chars, r.next_id) == (len(text), follows[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        near.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(near)) < 0.02 and np.abs(near).max() < 0.25


def test_sketch_is_the_smallest_hashes_and_merges(spark):
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(200, 700))
    df = spark.createDataFrame([("g", a), ("g", b)], "k string, t string").withColumn("s", sketches.sketch(F.col("t")))

    def plain(text):
        out = set()
        words = text.split()
        for i in range(len(words) - 4):
            h = 42
            for w in words[i : i + 5]:
                inner = xxhash.xxh64_intdigest(w.encode(), 42)
                h = xxhash.xxh64_intdigest(inner.to_bytes(8, "little"), h)
            out.add(h - (1 << 64) if h >> 63 else h)
        return out

    x, y = plain(a), plain(b)
    first, second = sorted(df.collect(), key=lambda r: len(r.t))
    assert first.s == sorted(x)[:128] and second.s == sorted(y)[:128]
    merged = sketches.merge_by(df, "k", "s").first()
    assert merged.s == sorted(x | y)[:128]
    pair = spark.createDataFrame([(first.s, second.s)], "a array<long>, b array<long>").select(
        sketches.resemblance(F.col("a"), F.col("b")), sketches.n_distinct(F.col("b")), sketches.containment(F.col("a"), F.col("b"))
    ).first()
    assert abs(pair[0] - len(x & y) / len(x | y)) < 0.15
    assert abs(pair[1] / len(y) - 1) < 0.3 and abs(pair[2] - len(x & y) / len(x)) < 0.25


# personal data


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m.group())]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.+-% ()0123456789é\n"), max_size=80))
def test_base_spans(text):
    assert sorted(pii.base_spans(text)) == plain_spans(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "a@b.co", "@c.de", "1.2.3.4", "+1 (555) 555-0100", " ", ".", "5", "x"]), max_size=12))
def test_base_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert sorted(pii.base_spans(text)) == plain_spans(text)


def test_pii_query(spark, texts):
    for r in queries.QUERIES["op8_pii"](spark, DATA).collect():
        want = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_trees_add_rewritten_spans(spark):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("aeioumnrst") for _ in range(5))
    rows = []
    for i in range(400):
        mail = f"{word()}@{word()}.com"
        rows.append((i, f"{word()} {word()} mail {mail} {word()} at {word()} {word()} 12345 67 {rnd.randrange(10**6)} {word()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    hidden = "please mail " + "anna (at) example (dot) com" + " soon at noon today"
    added = model.chosen([hidden, "we met at noon today near seven houses"], [[], []])
    assert [hidden[s:e].strip() for _, s, e in added[0]] == ["anna (at) example (dot) com"] and added[1] == []


def test_redaction_merges_overlapping_spans():
    assert pii._redacted("ab cdef gh", [(0, 3, 6), (3, 5, 7)]) == "ab [EMAIL] gh"


# language identification


def test_languages_of_documents(spark, docs):
    got = queries.QUERIES["op3_language_id"](spark, DATA).where("doc_id IS NOT NULL").join(docs.select("doc_id", "lang"), "doc_id")
    right, kept, n = got.agg(F.avg((F.col("lang") == F.col("language")).cast("int")), F.avg(F.col("kept").cast("int")), F.count("*")).first()
    assert right > 0.97 and kept > 0.97 and n == docs.count()


def test_host_and_declared_language_decide_short_texts(spark):
    rows = [(i, "the of and to in " * 10, "en", "x.example") for i in range(40)]
    rows += [(100 + i, "der die und das ist " * 10, "de", "y.example") for i in range(40)]
    rows += [(200, "xq", "en", "x.example"), (201, "xq", "de", "y.example"), (202, "...", "en", "x.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df.where("doc_id < 200"), "doc_id", "text", "lang")
    got = langid.identify(df, model, declared=F.col("lang"), host=F.col("source"))
    found = {r.doc_id: r._language for r in got.collect()}
    assert (found[200], found[201], found[202]) == ("en", "de", langid.UNKNOWN)


def test_rare_languages_are_known(spark):
    """Four rows of 6,000 are Finnish, and one of them has no id; all are in the model and named."""
    rows = [(i, "the of and to in " * 10 + str(i), "en", "x.example") for i in range(5996)]
    rows += [(6000 + i if i else None, f"ja on ei se että kanssa {i} " * 5, "fi", "y.example") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df, "doc_id", "text", "lang")
    assert model.languages == ["en", "fi"]
    got = langid.identify(df, model, declared=F.col("lang"), host=F.col("source"))
    assert got.where("lang = _language").count() == 6000
    assert langid.fit(df.where("lang = 'fi'"), "doc_id", "text", "lang").languages == ["fi"]


def test_sample_by_language_is_bounded_and_takes_the_smallest_hashes(spark):
    hot = spark.range(20_000).select(F.lit("a").alias("l"), F.pmod(F.xxhash64("id"), F.lit(1 << 52)).alias("h"))
    few = spark.createDataFrame([("b", 7), ("b", 7), ("b", (1 << 52) - 1)], "l string, h long")
    got = langid.sample_by_language(hot.unionByName(few), 100).collect()
    assert sorted(r.h for r in got if r.l == "a") == sorted(r.h for r in hot.collect())[:100]
    assert sorted(r.h for r in got if r.l == "b") == [7, (1 << 52) - 1]


def test_page_parts(spark):
    rows = [(1, "https://u:p@www.Example.DE:80/a?b", "<html lang='de-AT'><script>x</script><p>Hallo&amp;</p>"), (2, None, None)]
    got = langid.page_parts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert tuple(got[0])[1:] == ("Hallo&amp;", "de-AT", "de", "www.example.de")
    assert tuple(got[1])[1:] == ("", "", "", "")


# toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op1_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    ranks, toxic = got.score.rank(), got.toxic == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.75


def test_pu_classifier_corrects_for_hidden_positives():
    rnd = np.random.default_rng(0)
    positive = (rnd.random((300, 20)) < np.r_[[0.9] * 3, [0.3] * 17]).astype(float)
    hidden = (rnd.random((300, 20)) < np.r_[[0.9] * 3, [0.3] * 17]).astype(float)
    clean = (rnd.random((1200, 20)) < np.r_[[0.05] * 3, [0.3] * 17]).astype(float)
    model = toxicity.PUClassifier(0.2).fit(positive, np.concatenate([hidden, clean]))
    odds = lambda x: x @ model.weights + model.bias
    assert (odds(hidden) > 0).mean() > 0.9 and (odds(clean) > 0).mean() < 0.05


# boosted trees and pages


def test_boosted_trees_learn_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = BoostedTrees(rounds=40).fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93


def test_main_text_of_test_pages(spark):
    got = queries.QUERIES["op5_html_extraction"](spark, DATA)
    for r in got.join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))
        import html as h

        want = [re.sub(r"\s+", " ", h.unescape(re.sub("<[^>]*>", "", p))).strip() for p in parts]
        assert r.text == "\n\n".join(filter(None, want)) and r.n_chars == len(r.text)


MIXED = """<html><body class="page"><header><a href=/>Home</a><h2>Site</h2></header>
<ul class="menu"><li><a>One</a><li><a>Two</a></ul>
<main><div id="post-1"><h1>A &amp; B</h1><p>First   long paragraph, with words.<p>Second <b>paragraph</b>,<br>with a break. More text follows here.
<blockquote>Quoted words that belong to the story.</blockquote>
<div class="newsletter-signup">Subscribe now</div></div></main>
<section class="comments"><p>I liked this article a lot, thanks.</p></section>
<aside class="sidebar"><p>Related stuff</p></aside><form><label>Mail</label></form><div class="cookie-notice">We use cookies</div>
<footer><p>Imprint</p></footer><script>if (a<b) {}</script></body></html>"""


def test_main_text_without_the_rest(spark):
    pages_ = spark.read.parquet(f"{DATA}/pages.parquet")
    model = pages.fit(pages_)
    assert model.texts([MIXED]) == [
        "A & B\n\nFirst long paragraph, with words.\n\nSecond paragraph, with a break. More text follows here.\n\n"
        "Quoted words that belong to the story."
    ]


def test_decoding_has_no_contradiction():
    page = pages.parse("<div><div><p>a</p></div><p>b</p></div>")
    odds = np.array([1.0, -1.0, -5.0, 4.0, -0.5])
    kept = pages.decode(page, odds)
    assert all(kept[n.parent] for n, k in zip(page.nodes, kept) if k and n.parent >= 0)
    best = max(
        (sum(o if (m >> i) & 1 else -o for i, o in enumerate(odds)), m)
        for m in range(32)
        if m & 1 and all((m >> page.nodes[i].parent) & 1 for i in range(1, 5) if (m >> i) & 1)
    )[1]
    assert kept.tolist() == [bool((best >> i) & 1) for i in range(5)]


def test_parsing_is_linear():
    import time

    def took(markup):
        start = time.perf_counter()
        pages.parse(markup)
        return time.perf_counter() - start

    for unit in ("<p>", "<b>x</i>", "<li>", "<a ", "</p>", "<div>"):
        assert took(unit * 40_000) < 8 * took(unit * 10_000) + 0.5


# nearest neighbours


def test_neighbours_recall(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 24))
    x[500:800] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"))
    got = ann.neighbours(ann.build(df), asked).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in got.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(len(x)), -score.round(12)))[:5]
        hit += len(set(want) & set(found.vec_id))
        assert np.allclose(found.score, score[found.vec_id]) and list(found["rank"]) == sorted(found["rank"])
    assert len(got) == 300 and hit / 300 >= 0.95


# repeated passages


def plain_passages(texts, size=50):
    seen = {}
    for d, t in texts.items():
        w = t.encode().split()
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((d, i))
    marked = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marked.setdefault(d, set()).update(range(i, i + size))
    out = set()
    for d, words in marked.items():
        runs = sorted(words)
        starts = [x for x in runs if x - 1 not in words]
        ends = [x + 1 for x in runs if x + 1 not in words]
        out |= set(zip([d] * len(starts), starts, ends))
    return out


@pytest.mark.parametrize("part", [2048, 4])
def test_passages(spark, monkeypatch, part):
    monkeypatch.setattr(repeats, "PART", part)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    fresh = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 90, 200)]
    texts = {}
    for d in range(60):
        parts = fresh(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            chosen = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                chosen[rnd.randrange(len(chosen))] = "edit"
            parts += chosen + fresh(rnd.randint(0, 60))
        texts[d] = " ".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeats.passages(df).collect()}
    assert got == plain_passages(texts)


def test_passages_of_one_phrase_and_of_repeated_rows(spark):
    """One text that says the same 40,000 times is dealt over many parts; a repeated row is no repeat."""
    hot = "buy now " * 40_000
    alone = " ".join(f"w{i}" for i in range(200))
    rows = [(1, hot), (2, alone), (2, alone), (2, alone), (3, "x " + " ".join(f"w{i}" for i in range(100, 160)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeats.passages(df).collect()}
    assert got == {(1, 0, 80_000), (2, 100, 160), (3, 1, 61)}
    keyed = df.select(F.xxhash64("doc_id", "text").alias("doc"), "text").where("doc_id = 1")
    dealt = repeats._suffixes(keyed, True).groupBy("key", F.pmod(F.xxhash64("doc", "at"), F.lit(40)).alias("part")).count()
    assert dealt.agg(F.max("count")).first()[0] < repeats.PART


# mixing


def test_mixing_meets_its_targets(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(3000):
        source, lang = f"s{min(rnd.randrange(6), rnd.randrange(6))}", rnd.choice(["en", "en", "en", "de", "fr"])
        text = "word " * rnd.randint(5, 60) + rnd.choice(["", "", " | x", " license"])
        rows.append((i, text, lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.Targets({"en": 0.4, "de": 0.4, "fr": 0.2}, {"prose": 0.5, "table": 0.25, "legal": 0.25}, budget=0.1)
    got = mixing.weighted(df, targets).toPandas()
    got["expected"] = got._tokens * got._probability
    total = got.expected.sum()
    assert abs(total / got._tokens.sum() - 0.1) < 0.005 and got._probability.max() < 1
    for column, wanted in (("_lang", targets.languages), ("_topic", targets.topics)):
        for name, share in wanted.items():
            assert abs(got[got[column] == name].expected.sum() / total - share) < 1e-3
    power = got.groupby("_source")._tokens.sum() ** 0.5
    assert np.allclose(got.groupby("_source").expected.sum() / total, power / power.sum(), atol=1e-3)
    # against plain iterative proportional fitting on the table of cells
    cells = got.groupby(["_source", "_lang", "_topic"])._tokens.sum().astype(float)
    fit = cells.copy()
    for _ in range(200):
        for level, wanted in (("_source", power / power.sum()), ("_lang", targets.languages), ("_topic", targets.topics)):
            now = fit.groupby(level=level).sum()
            fit = fit * fit.index.get_level_values(level).map(lambda x: wanted[x] / now[x]).to_numpy()
    mine = got.groupby(["_source", "_lang", "_topic"]).expected.sum() / total
    assert np.allclose(mine, fit / fit.sum(), atol=1e-3)
    assert abs(got[got._drawn]._tokens.sum() / got._tokens.sum() - 0.1) < 0.03


def test_mixing_meets_its_budget_when_targets_contradict(spark):
    """Most sources have English only, one of them is hot: factors end up dozens of powers of ten apart."""
    rows = [(f"s{i}", "en", 4000 if i == 0 else 40) for i in range(30)]
    rows += [(f"s{i}", lang, 10) for i in range(30, 40) for lang in ("en", "de", "fr", "es")]
    df = spark.createDataFrame(rows, "source string, lang string, docs int")
    df = df.select("source", "lang", F.explode(F.sequence(F.lit(1), "docs")).alias("i"))
    df = df.select(F.xxhash64("source", "lang", "i").alias("doc_id"), F.expr("repeat('word ', 20 + i % 20)").alias("text"), "lang", "source")
    for budget in (0.5, 0.02, 0.0):
        got = mixing.weighted(df, mixing.Targets(budget=budget)).toPandas()
        expected = (got._tokens * got._probability).sum()
        assert abs(expected - budget * got._tokens.sum()) <= 1e-4 * got._tokens.sum(), budget
        assert got._probability.between(0, 1).all()


# pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipeline

    now, sizes = docs, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA)
        assert after.columns == docs.columns, name
        now = after.cache()
        sizes.append(now.count())
    assert sizes[1] >= 0.97 * sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and 0 < sizes[4] < sizes[3]
    last = pipeline.STAGES[-1][1](spark, now, DATA).collect()
    held = {r.doc_id: r.text for r in now.collect()}
    assert {r.doc_id: r.n_tokens for r in last} == {d: len(LIBRARY.encode_ordinary(t)) for d, t in held.items()}
    assert all(not plain_spans(t) for t in held.values())
    assert pipeline.run(spark, DATA).count() == len(last)
