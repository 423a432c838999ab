import json

import pytest
from pyspark.sql import functions as F

from postlake.functions import jsonv as jv
from postlake.operators import payloads as pl
from postlake.operators import records as rec
from postlake.operators import signals as sg

BASE = "https://h.com/careers"


def bodies(spark, *objs):
    rows = [("s", i, f"https://h.com/{i}", BASE, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objs)]
    df = spark.createDataFrame(rows, "site string, seq int, url string, base_url string, body string")
    return df.withColumn("body_length", F.length("body"))


def variant(one, column, obj):
    return one(column(jv.parse(F.lit(json.dumps(obj)))))


def test_first_key_takes_strings_and_small_objects_only(one):
    def get(obj, keys=("id", "reqId")):
        return one(pl.first_key(jv.as_map(jv.parse(F.lit(json.dumps(obj)))), keys))

    assert get({"id": 7, "reqId": "R7"}) == "R7"
    assert get({"id": {"value": " a "}}) == "a"
    assert get({"id": {"value": 5, "text": "b"}}) is None
    assert get({"id": {"value": "", "text": "b"}}) == "b"
    assert get({"id": ["x"], "reqId": " "}) is None
    assert get({}) is None


@pytest.mark.parametrize(
    "read",
    [
        lambda v: pl.first_key(jv.as_map(v), ("title", "job_title", "name")),
        pl.raw_skills,
        pl.raw_list,
        jv.string_value,
        jv.is_scalar,
    ],
)
def test_a_raw_object_is_parsed_once_a_row(spark, read):
    rows = spark.createDataFrame([('{"skills": "a, b"}',)], "raw string").select(read(jv.parse(F.col("raw"))).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("raw#") == 2  # read once, given once by its source


def test_raw_skills_keep_the_order_of_their_branches(one):
    get = lambda obj: variant(one, pl.raw_skills, obj)
    assert get({"skills": " , ", "tools": "c"}) == []
    assert get({"bulletFields": {"skills": [], "requirements": "x"}}) == []
    assert get({"bulletFields": {"skills": ["p", " "], "requirements": "x"}}) == ["p"]
    assert get({"skills": None, "tools": 3, "bulletFields": None}) == [] and get("text") == []
    assert variant(one, pl.raw_list, {"qualifications": [], "requirements": "r"}) == []
    assert variant(one, pl.raw_list, {"qualifications": " ", "requirements": " r "}) == ["r"]


def test_raw_skills(one):
    get = lambda obj: variant(one, pl.raw_skills, obj)
    assert get({"skills": ["a", " ", "b"], "tools": "c"}) == ["a", "b"]
    assert get({"skills": [], "tools": "c, d,"}) == ["c", "d"]
    assert get({"bulletFields": {"skills": "x; y"}}) == ["x", "y"]
    assert get({"bulletFields": {"qualifications": []}}) == []
    assert len(get({"skills": [str(i) for i in range(40)]})) == 15
    assert variant(one, pl.raw_list, {"qualifications": [], "requirements": "x"}) == []
    assert variant(one, pl.raw_list, {"requirements": " x "}) == ["x"]


def test_raw_sections_keep_document_order(one):
    obj = '{"zeta": "long enough", "title": "t", "b": true, "a": 3, "tiny": "abc", "n": null, "o": {"x": 1}, "m": "123456", "k": "another", "j": "one more"}'
    got = one(pl.raw_sections(F.lit(obj)))
    assert [(s.section_title, s.content) for s in got] == [
        ("zeta", "long enough"), ("b", "True"), ("a", "3"), ("m", "123456"), ("k", "another"),
    ]


def test_enrich_from_raw(spark):
    raw = {"name": "Dev", "city": "Pune", "country": {"text": "IN"}, "id": 5, "department": "Ops", "skills": "a,b", "remote": "yes"}
    df = spark.createDataFrame([("", "", json.dumps(raw))], "title string, location string, raw string")
    r = pl.enrich_from_raw(df).first()
    assert (r.title, r.location, r.job_id, r.department, r.remote_type) == ("Dev", "Pune", "", "Ops", "yes")
    assert r.skills == ["a", "b"] and r.additional_sections == []


@pytest.mark.parametrize(
    "body, titles",
    [
        ([{"t": 1}, {"t": 2}], [1, 2]),
        ({"jobs": [], "careers": [{"t": 3}]}, [3]),
        ({"x": [1], "z": [{"title": 1, "t": 4}], "a": [{"location": 1, "t": 5}]}, [4]),
        ({"k9": {"t": 6}, "k1": [{"t": 7}, 3]}, [6, 7]),
        ("3", []),
        ({"n": 1}, []),
    ],
)
def test_find_job_list(spark, body, titles):
    rows = pl.find_job_list(bodies(spark, body)).orderBy("pos").collect()
    assert [json.loads(r.raw)["t"] for r in rows] == titles


def test_normalize_job_entry(spark):
    jobs = [
        {"title": "Dev", "location": {"value": "Pune"}, "applyUrl": "/a/1", "id": 4, "department": "Ops"},
        {"name": "QA", "state": "MH", "country": "IN", "reqId": "R1"},
        {"jobTitle": "PM"},
        {"title": "x"},
        "text",
    ]
    rows = pl.normalize_job_entry(pl.find_job_list(bodies(spark, jobs)), "base_url").orderBy("pos").collect()
    assert [(r.title, r.location, r.url, r.job_id) for r in rows] == [
        ("Dev", "Pune", "https://h.com/a/1", ""),
        ("QA", "IN", "https://h.com/job/R1", "R1"),
        ("PM", "", BASE, ""),
    ]
    assert rows[0].department == "Ops"


def job(n, **more):
    return {"title": f"T{n}", "location": "Pune", "url": f"/j/{n}", **more}


def test_extract_listing_jobs(spark):
    nested = {"zeta": {"more": [[{"x": job(2)}]], "title": "no place"}, "alpha": job(1, child=job(3)), "note": "{not json"}
    rows = (
        pl.extract_listing_jobs(
            bodies(spark, {"positions": [job(1), job(1), 5]}, [job(1), {"title": " ", "city": "x"}], nested, {"jobs": [], "x": job(9)}, "oops")
        )
        .orderBy("seq")
        .collect()
    )
    assert [[j.title for j in r.jobs] for r in rows] == [["T1"], ["T1"], ["T2", "T1", "T3"], ["T9"], []]
    assert [r.has_list_key for r in rows] == [True, False, False, True, False]
    assert [r.from_list for r in rows] == [True, True, False, False, False]
    assert rows[0].jobs[0].url == "https://h.com/j/1"


def test_jobs_are_found_at_any_depth(spark):
    deep = job(1)
    for _ in range(60):
        deep = {"x": [deep]}
    assert [j.title for j in pl.extract_listing_jobs(bodies(spark, deep)).first().jobs] == ["T1"]


def test_location_text(one):
    get = lambda v: variant(one, lambda x: pl.location_text(jv.field(x, "v")), {"v": v})
    assert get({"name": "", "city": "Pune"}) == "Pune"
    assert get({"zip": "1"}) == ""
    assert get(["a", " ", 3]) == "a, 3"
    assert get(" x ") == "x" and get(12) == "12" and get(None) == ""


def test_platform_postings(spark):
    board = {"jobs": [{"title": " A ", "absolute_url": "u1", "location": {"name": "X"}}, {"title": "B"}, 3]}
    rows = pl.board_postings(bodies(spark, board).drop("url")).collect()
    assert [(r.title, r.location, r.url) for r in rows] == [("A", "X", "u1")]
    assert json.loads(rows[0].raw)["absolute_url"] == "u1"
    wd = {"jobPostings": [{"title": "A", "externalPath": "/job/x", "locationsText": "P"}, {"title": "", "externalPath": "/y"}]}
    site = bodies(spark, wd).drop("url").withColumn("site_url", F.lit("https://acme.wd1.myworkdayjobs.com/Careers?x=1"))
    assert [r.url for r in pl.workday_postings(site).collect()] == [
        "https://acme.wd1.myworkdayjobs.com/en-US/Careers/job/job/x"
    ]
    assert [r.url for r in pl.workday_postings(site, join_urls=True).collect()] == [
        "https://acme.wd1.myworkdayjobs.com/job/x"
    ]


def test_parse_replies(spark):
    good = '{"title": " Dev ", "location": "Pune", "required_skills": ["SQL", "sql", 3], "job_description": "long", "salary": 5}'
    rows = [(0, good), (1, f"```json\n{good}\n```"), (2, "not json"), (3, "[1]"), (4, '{"additional_sections": [{"section_title": "a"}, 1]}')]
    out = pl.parse_replies(spark.createDataFrame(rows, "page_id long, content string")).orderBy("page_id").collect()
    for r in out[:2]:
        assert (r.title, r.location, r.required_skills, r.job_description, r.salary) == ("Dev", ["Pune"], ["SQL", "3"], "", "5")
    assert [r.is_valid for r in out] == [True, True, False, False, True]
    assert out[2].title == "" and out[2].required_skills == [] and out[2].additional_sections == []
    assert [(s.section_title, s.content) for s in out[4].additional_sections] == [("a", "")]


def test_prompts(spark):
    df = spark.createDataFrame([("body", {"title": 'A "b"', "x": ""}, "sum", ["c1", "c2"])], "text string, known map<string,string>, summary string, chunks array<string>")
    full = pl.build_prompts(df, mode="workday").first().prompt
    assert full.startswith('Already confirmed (use these as-is, do NOT contradict):\n{\n  "title": "A \\"b\\""\n}\n\n---')
    assert "INPUT (FULL Workday job posting - NO FILTERING APPLIED):\nbody\n\n---" in full and full.endswith("OUTPUT:")
    part = pl.build_prompts(df, mode="filtered").first().prompt
    assert "JOB SUMMARY:\nsum\n\n---\n\nSECTION 1:\nc1\n\n---\n\nSECTION 2:\nc2\n\n" in part


def test_request_template(spark):
    best = spark.createDataFrame([("a", "https://h/api?x=1"), ("b", "https://h/q")], "site string, url string")
    requests = spark.createDataFrame(
        [
            ("a", 0, "https://other", "PUT", {"k": "0"}, None),
            ("a", 2, "https://h/", "GET", {"k": "2"}, None),
            ("a", 1, "https://h/api", "POST", {"k": "1"}, '{"q": 1}'),
        ],
        "site string, seq int, url string, method string, headers map<string,string>, post_data string",
    )
    a, b = pl.request_template(best, requests).orderBy("site").collect()
    assert (a.method, a.headers, a.payload, a.payload_is_json) == ("POST", {"k": "1"}, '{"q": 1}', True)
    assert (b.method, b.headers, b.payload) == ("GET", {}, None)


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (rec.norm_location, None, []),
        (rec.norm_location, " ", []),
        (rec.norm_location, ["a", "", {"x": 1}], ["a"]),
        (rec.norm_location, {"addressLocality": "P", "name": "HQ"}, ["P, HQ"]),
        (rec.norm_location, 5, ["5"]),
        (rec.norm_experience, {"value": {"minValue": 3}}, "3"),
        (rec.norm_experience, {"value": {"x": 1}, "description": "d"}, "d"),
        (rec.norm_experience, ["1", None, "2"], "1, 2"),
        (rec.norm_salary, {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2}}, "EUR 1-2"),
        (rec.norm_salary, {"text": "x"}, ""),
        (rec.norm_salary, {"value": None, "text": "x"}, "x"),
        (rec.norm_salary, {"value": "5"}, "5"),
        (rec.norm_education, {"credentialCategory": "", "description": "BSc"}, "BSc"),
        (rec.norm_education, 3, "3"),
        (rec.norm_list, ["A", "a ", 1, {"x": 1}], ["A", "1"]),
        (rec.norm_list, "x", ["x"]),
        (rec.norm_list, [], []),
    ],
)
def test_normalisers(one, fn, value, want):
    assert variant(one, lambda x: fn(jv.field(x, "v")), {"v": value}) == want


def test_distinct_ci_is_stable_when_run_twice(one):
    words = F.array(*[F.lit(w) for w in ["Go", "go", " SQL", "", "sql", "Java"]])
    once = rec.distinct_ci(words)
    assert one(once) == ["Go", "SQL", "Java"] == one(rec.distinct_ci(once))


@pytest.mark.parametrize(
    "body, want",
    [
        ([1, 2, 3], 3),
        ({"data": [], "total": 9}, 0),
        ({"total": 9}, 9),
        ({"total": "9", "count": 4}, 4),
        ({"total": True}, 1),
        ({"a": {"title": 1}, "b": {"x": 1}, "c": [{"location": 1}, 2]}, 3),
        ({"a": {"job_title": 1}}, 1),
        ("oops", 0),
    ],
)
def test_estimate_jobs(one, body, want):
    text = body if isinstance(body, str) else json.dumps(body)
    assert one(sg.estimate_jobs(F.lit(text))) == want


def test_paging_flags(one):
    assert one(sg.has_paging(F.lit('{"hasMore": false}')))
    assert not one(sg.has_paging(F.lit('{"x": {"total": 1}}')))
    assert not one(sg.has_paging(F.lit("[1]")))
    assert one(sg.mentions_paging(F.lit('{"x": {"pageSize": 1}}')))


def test_validate_endpoints(spark):
    many = [job(i) for i in range(7)]
    df = (
        bodies(
            spark, {"jobs": many, "page": 1}, "{", {}, {"jobs": [job(1)]}, {"jobs": many, "menu": 1, "layout": 2},
            {"a": 1}, {"a": "title position location"}, [job(1), job(2)],
        )
        .withColumn("status", F.lit(200))
        .withColumn("content_type", F.lit("application/json"))
    )
    rows = sg.validate_endpoints(df).orderBy("seq").collect()
    assert [r.reason for r in rows] == [
        "accepted", "json_parse_failed", "empty_payload", "single_job_endpoint", "ui_navigation_payload",
        "missing_job_structure", "no_job_like_fields", "accepted",
    ]
    assert [rows[0].score, rows[7].score] == [6, 1]
    bad = sg.validate_endpoints(df.limit(1).withColumn("status", F.lit(500))).first().reason
    assert bad == "http_error"
    best = sg.best_endpoint(sg.validate_endpoints(df).withColumn("rank", F.col("seq"))).collect()
    assert [(b.api_url, b.jobs_found) for b in best] == [("https://h.com/0", 7)]


def test_many_jobs_of_one_payload_take_about_linear_time(spark):
    import json
    import time

    def took(n):
        jobs = [{"title": f"Job {i // 2}", "location": "NYC", "url": f"/j/{i // 2}"} for i in range(n)]
        df = spark.createDataFrame([(json.dumps({"jobs": jobs}), "https://h.com")], "body string, base_url string")
        start = time.perf_counter()
        assert len(pl.extract_listing_jobs(df).first().jobs) == n // 2
        return time.perf_counter() - start

    took(1000)
    assert took(8000) < 3 * took(4000) + 1
