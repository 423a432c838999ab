import json

from pyspark.sql import functions as F

from postlake.operators import candidates as cand
from postlake.operators import dedupe as dd
from postlake.operators import merge as mg
from postlake.operators import records as rec

SITES = "id long, domain string, type string, confidence double"
JOBS = "id long, site_id long, title string, location string, url string, raw_json string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_jobs_last_row_wins_and_is_idempotent(spark):
    jobs = spark.createDataFrame([(7, 1, "old", "x", "u1", "{}"), (9, 1, "kept", "x", "u9", "{}")], JOBS)
    batch = spark.createDataFrame(
        [(1, 1, "a", "l", " u1 ", "{1}"), (2, 1, "b", "l", "u1", "{2}"), (3, 1, " ", "l", "u2", "{}"), (4, 2, "c", None, "u1", "{}"), (5, 1, "d", "", "", "{}")],
        "seq long, site_id long, title string, location string, url string, raw_json string",
    )
    once = mg.upsert_jobs(jobs, batch)
    known, added = once.where("id < 10"), once.where("id >= 10")
    assert rows(known, "id", "site_id", "title", "url") == [(7, 1, "b", "u1"), (9, 1, "kept", "u9")]
    assert rows(added, "site_id", "title", "url") == [(2, "c", "u1")]
    twice = mg.upsert_jobs(spark.createDataFrame(once.collect(), JOBS), batch)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_new_ids_are_unique_and_the_same_for_any_partitioning(spark):
    known = spark.createDataFrame([(41,)], "id long")
    new = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    got = [rows(mg.assign_ids(new.repartition(n), known, ["k"]), "k", "id") for n in (1, 7)]
    assert got[0] == got[1]
    ids = [i for _, i in got[0]]
    assert len(set(ids)) == 500 and min(ids) > 41


def test_merge_delta_priority(spark):
    base = spark.createDataFrame([(1, "T", "S", ["a"]), (2, "", "S", [])], "page_id long, title string, salary string, skills array<string>")
    delta = spark.createDataFrame([(1, "X", "", ["b"], "B"), (2, "Y", "Z", [], "")], "page_id long, title string, salary string, skills array<string>, about string")
    out = mg.merge_delta(base, delta, "page_id").orderBy("page_id").collect()
    assert [(r.title, r.salary, r.skills, r.about) for r in out] == [("T", "S", ["b"], "B"), ("Y", "Z", [], None)]


def test_cascade(spark):
    schema = "page_id long, record struct<title:string,location:string,description:string,salary:string,skills:array<string>,experience:string>"
    post = spark.createDataFrame([(1, ("P", None, None, None, [], None)), (2, (None, None, "d", None, [], None))], schema)
    html = spark.createDataFrame([(i, ("H", None, None, None, [], None)) for i in (1, 2, 3)], schema)
    out = mg.cascade(post, html).orderBy("page_id").collect()
    assert [(r.record.title, r.parser_used) for r in out] == [("P", "json_ld"), ("H", "html_basic"), ("H", "html_basic")]


def test_defaults_and_detail_merges(spark):
    listings = spark.createDataFrame([("u1", "L1", "P"), ("u2", "L2", "Q")], "url string, title string, location string")
    details = spark.createDataFrame([("u1", "", "R", None, ["s"])], "url string, title string, location string, salary string, skills array<string>")
    assert rows(mg.merge_api_detail(listings, details), "title", "location") == [("L1", "R"), ("L2", "Q")]
    assert rows(mg.merge_dom_detail(listings, details), "title", "location") == [("L1", "R"), ("L2", "Q")]
    out = mg.with_defaults(listings, details).orderBy("url").collect()
    assert [(r.title, r.location, r.salary, r.skills, r.is_default) for r in out] == [
        ("", "R", "", ["s"], False), ("L2", "Q", "", [], True),
    ]


def test_attach_raw_uses_the_first_posting(spark):
    jobs = spark.createDataFrame([("s", "u1"), ("s", "u2")], "site string, url string")
    posts = spark.createDataFrame([("s", "u1", 1, "B"), ("s", "u1", 0, "A")], "site string, url string, pos int, raw string")
    assert rows(mg.attach_raw(jobs, posts).fillna(""), "url", "raw") == [("u1", "A"), ("u2", "")]


def test_records(spark):
    df = spark.createDataFrame(
        [("https://h/x/9", "T", ["Pune"], "", ["q1", "q2"], [], ["S"], [("a", "b")])],
        "url string, title string, location array<string>, education string, qualifications array<string>, skills array<string>, "
        "required_skills array<string>, additional_sections array<struct<section_title:string,content:string>>",
    )
    new, old = mg.to_record_api(df).first(), mg.to_record_api(df, compat=True).first()
    assert (new.id, new.locations, new.required_skill_set, new.educational_qualifications) == ("9", ["Pune"], ["S"], "q1, q2")
    assert (old.required_skill_set, old.educational_qualifications) == ([], "['q1', 'q2']")
    assert len(new.asDict()) == 18 and new.ai_usage.total_tokens == 0
    dom = mg.to_record_dom(df).select(F.to_json("Scrap_json").alias("s")).first().s
    assert json.loads(dom)["strategy"] == "INTERACTIVE_DOM" and json.loads(dom)["benefits"] == []


# --- Windows ----------------------------------------------------------------


def test_stop_rules(spark):
    def keys(pages, **options):
        data = [("s", p, k, i) for i, (p, ks) in enumerate(pages) for k in ks]
        df = spark.createDataFrame(data, "site string, page int, k string, seq int")
        return sorted(r.k for r in dd.stop_on_no_growth(df, "site", "page", "k", ["seq"], **options).collect())

    repeat = [(0, "ab"), (1, "bc"), (2, "abc"), (3, "d"), (4, "a"), (5, "b"), (6, "e")]
    assert keys(repeat) == ["a", "b", "c"]
    assert keys(repeat, patience=2) == ["a", "b", "c", "d"]
    assert keys(repeat, patience=3) == ["a", "b", "c", "d", "e"]
    assert keys(repeat, min_page=3) == ["a", "b", "c", "d"]
    assert keys(repeat, patience=3, max_pages=3) == ["a", "b", "c"]
    assert keys([(0, "a"), (2, "b")]) == ["a"]
    assert keys([(0, "a"), (2, "b")], patience=2) == ["a", "b"]
    assert keys([(1, "a")]) == []


def test_rankings_limit_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    for out in (dd.dedupe_first(df, ["k"], ["id"]), dd.top_n_per(df, ["k"], ["id"], 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2, plan
    assert dd.dedupe_first(df, ["k"], ["id"]).count() == 3


def test_dedupe_is_stable_when_run_twice_and_for_any_partitioning(spark):
    df = spark.createDataFrame([("", "A", "P", 0), ("", "a", "p", 1), ("U", "B", "", 2), ("u", "C", "", 3), (None, "A", "P", 4)], "url string, title string, location string, pos int")
    lower = dd.dedupe_listings(df.repartition(3), ["pos"], lower=True)
    assert rows(lower, "pos") == [(0,), (2,)] == rows(dd.dedupe_listings(lower, ["pos"], lower=True), "pos")
    assert rows(dd.dedupe_listings(df, ["pos"]), "pos") == [(0,), (1,), (2,), (3,)]


def test_latest_keeps_every_row_of_the_newest_run(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "k string, ts int, v int")
    assert rows(dd.latest_per(df, ["k"], "ts"), "v") == [(2,), (3,), (4,)]


# --- Candidates -------------------------------------------------------------


def test_board_slug_evidence_order(spark):
    sites = spark.createDataFrame([("a", "boards.greenhouse.io/acme/jobs"), ("b", "b.com"), ("c", "c.com"), ("d", "d.com")], "site string, url string")
    found = spark.createDataFrame([("b", 0, "https://x/?for=one"), ("b", 1, "https://boards.greenhouse.io/two"), ("a", 0, "https://x/?for=no")], "site string, seq int, url string")
    pages = spark.createDataFrame([("b", '<a href="https://boards.greenhouse.io/three">'), ("c", "?for=four https://job-boards.greenhouse.io/five")], "site string, html string")
    fetched = spark.createDataFrame([("c", "https://c.com", "")], "site string, final_url string, html string")
    out = {r.site: (r.slug, r.source, r.board_url) for r in cand.resolve_board_slug(sites, found, pages, fetched).collect()}
    assert out == {
        "a": ("acme", "direct_greenhouse_url", "https://boards.greenhouse.io/acme/jobs"),
        "b": ("one", "browser_xhr_query_param", "https://x/?for=one"),
        "c": ("five", "company_html_board_url", "https://job-boards.greenhouse.io/five"),
        "d": ("", "fetch_failed", ""),
    }


def test_json_candidates_are_capped_in_order(spark):
    sites = spark.createDataFrame([("a", "h.com/careers/?x=1")], "site string, url string")
    found = spark.createDataFrame([("a", 0, "https://h.com/asset.js"), ("a", 1, "https://api/jobs"), ("a", 2, "https://h.com/jobs")], "site string, seq int, url string")
    got = [r.candidate for r in cand.json_candidates(sites, found).orderBy("rank", "seq", "sub").collect()]
    assert got == [
        "https://api/jobs", "https://h.com/jobs", "https://h.com/careers", "https://h.com/careers.json",
        "https://h.com/jobs.json", "https://h.com/careers/jobs", "https://h.com/careers/jobs.json", "https://h.com/api/jobs",
    ]


# --- Whole pipeline ---------------------------------------------------------


def test_extract_details(spark):
    posting = {"@type": "JobPosting", "title": "Dev", "jobLocation": "Pune", "description": "d" * 400, "skills": "SQL"}
    page = f'<script type="application/ld+json">{json.dumps(posting)}</script><h1>Other</h1>'
    pages = spark.createDataFrame([(1, page), (2, "<h1>Plain Job</h1>"), (3, "")], "page_id long, html string")
    replies = spark.createDataFrame(
        [(1, '{"title": "No", "salary": "9"}', 1, 2, 3), (2, '{"title": "No", "location": ["A", "B"], "required_skills": ["Go", "go"]}', 4, 5, 9)],
        "page_id long, content string, prompt_tokens int, completion_tokens int, total_tokens int",
    )
    a, b, c = rec.extract_details(pages, replies).orderBy("page_id").collect()
    assert (a.title, a.location, a.salary, a.skills) == ("Dev", ["Pune"], "", ["SQL"])
    assert (a._meta.parser_used, a._meta.confidence, a._meta.ai_used, a.ai_usage.total_tokens) == ("json_ld", 6, False, 0)
    assert (b.title, b.location, b.required_skills) == ("Plain Job", ["A", "B"], ["Go"])
    assert (b._meta.parser_used, b._meta.ai_used, b.ai_usage.total_tokens) == ("html_basic", True, 9)
    assert (c.title, c.location, c._meta.confidence) == ("", [], 0)
    assert "description" not in a.asDict()
    forced = rec.extract_details(pages, replies, force=True).where("page_id = 1").first()
    assert (forced.title, forced.salary, forced._meta.ai_forced) == ("Dev", "9", True)
    alone = rec.extract_details(pages).where("page_id = 1").first()
    assert (alone.title, alone.ai_usage.total_tokens) == ("Dev", 0)


def test_a_hot_key_changes_nothing(spark):
    """A third of all rows share one key; results equal brute force for any partitioning."""
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i % 17, i) for i in range(3000)]
    df = spark.createDataFrame(data, "site string, v int, seq int").repartition(9, "seq")
    best, first, top = {}, {}, {}
    for site, v, seq in data:
        best[site] = min(best.get(site, (99, 9999)), (v, seq))
        first.setdefault((site, v), seq)
        top.setdefault(site, []).append((v, seq))
    assert rows(dd.dedupe_first(df, ["site"], ["v", "seq"]), "site", "v", "seq") == sorted((s, *b) for s, b in best.items())
    assert rows(dd.ordered_distinct(df, "v", ["seq"], ["site"]), "site", "v", "seq") == sorted((s, v, q) for (s, v), q in first.items())
    want = sorted((s, q) for s, vs in top.items() for _, q in sorted(vs)[:5])
    assert rows(dd.top_n_per(df, ["site"], ["v", "seq"], 5), "site", "seq") == want


def test_a_repeated_detail_gives_one_row(spark):
    listings = spark.createDataFrame([("u1", "T")], "url string, title string")
    details = spark.createDataFrame([("u1", "B"), ("u1", "A")], "url string, title string")
    for merge in (mg.merge_api_detail, mg.merge_dom_detail, mg.with_defaults):
        assert [r.title for r in merge(listings, details, order=("title",)).collect()] == ["A"] if merge is not mg.with_defaults else merge(listings, details).count() == 1
