import json

import pytest
from pyspark.sql import functions as F

from postlake.operators import signals as sg

SIGNALS = "site string, job_link_count int, keyword_hits int, pagination_hits int, browser_signal_count int, job_anchor_count int, next_controls int, numbered_pagination int"


def test_page_signals_count_terms_and_links_once(pages):
    page = (
        '<p>Jobs jobs JOB apply</p><a href="/careers/job/1">Job</a><a href="/x">Apply</a><a href="/y">About</a>load more'
    )
    r = sg.page_signals(pages(page)).first()
    assert (r.keyword_hits, r.pagination_hits, r.job_link_count, r.browser_signal_count) == (3, 1, 2, 0)


def test_paged_detector(spark):
    rows = [
        ("a", 3, 0, 0, 0, 0, 0, 0), ("b", 3, 0, 1, 0, 0, 0, 0), ("c", 0, 4, 0, 0, 0, 5, 1),
        ("d", 0, 0, 0, 0, 4, 0, 9), ("e", 2, 3, 1, 9, 3, 1, 1),
    ]
    out = {r.site: r for r in sg.detect_paged(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert [(out[s].matched, out[s].usable, out[s].confidence) for s in "abcde"] == [
        (True, False, 0), (True, True, 2), (True, True, 5), (True, True, 4), (False, False, 0),
    ]
    assert out["d"].jobs_found == 4


def test_load_more_and_scroll_detectors(spark):
    df = spark.createDataFrame(
        [("a", 5, 3, 9, False, False, 0, 0), ("b", 5, 1, 0, True, True, 0, 7), ("c", 5, 0, 0, False, True, 0, 7), ("d", 1, 2, 2, True, True, 6, 1)],
        "site string, job_anchor_count int, load_more_controls int, load_more_growth int, load_more_clicked boolean, "
        "scrollable_container boolean, scroll_growth int, page_height_delta int",
    )
    load = {r.site: r for r in sg.detect_load_more(df).collect()}
    assert [load[s].confidence for s in "abcd"] == [10, 5, 0, 0]
    scroll = {r.site: r for r in sg.detect_infinite(df).collect()}
    assert [(scroll[s].usable, scroll[s].confidence) for s in "abcd"] == [(False, 0), (False, 0), (True, 6), (False, 0)]


def test_interactive_detector(spark):
    page = "<p>job apply role team</p>" + '<a href="/jobs/1">x</a>' * 4
    rows = [("a", True, "x" * 50, page, 2), ("b", True, page, page, 9), ("c", False, "x", page, 9), ("d", True, "", page, 9)]
    df = spark.createDataFrame(rows, "site string, available boolean, initial_html string, final_html string, job_links_count int")
    out = {r.site: r for r in sg.detect_interactive(df).collect()}
    assert [out[s].matched for s in "abcd"] == [True, False, False, False]
    growth = min(0.4, (len(page) - 50) / 50 * 0.1)
    assert out["a"].confidence == min(0.95, 0.40 + growth + min(0.3, 4 * 0.03) + min(0.3, 4 * 0.02))
    assert out["b"].job_links_count == 9 and out["b"].jobs_found == 0


def test_dom_signal_deltas(spark):
    df = spark.createDataFrame([("a", 0, 5, 100), ("a", 1, 9, 150), ("a", 2, 7, 90)], "site string, phase int, job_anchor_count int, page_height int")
    r = sg.dom_signal_deltas(df).first()
    assert (r.job_anchor_count, r.page_height_delta, r.load_more_growth, r.scroll_growth) == (7, 0, 4, 0)


@pytest.mark.parametrize(
    "body, length, want",
    [
        ('{"title": 1, "location": 2, "job": 3}', 600, 3 + 2 + 2),
        ('{"description": 1, "next": 2}', 600, 3 + 2),
        ('{"x": 1}', 10, -3),
        ("null", 4, 0),
        (None, 0, 0),
    ],
)
def test_response_score(one, body, length, want):
    assert one(sg.response_score(F.lit(body).cast("string"), F.lit(length))) == want


def test_dynamic_detector_takes_the_first_best(spark):
    body = json.dumps({"jobs": [{"title": "a", "location": "b", "description": "c"}] * 3, "total": 99})
    rows = [("a", 0, "https://h/x", "[]", 900), ("a", 1, "https://h/api?p=1", body, 900), ("a", 2, "https://h/api?p=2", body, 900), ("b", 0, "https://b/x", "[]", 2)]
    responses = spark.createDataFrame(rows, "site string, seq int, url string, body string, body_length int")
    requests = spark.createDataFrame([("a", 0, "https://h/api", "POST", {"h": "1"}, "q")], "site string, seq int, url string, method string, headers map<string,string>, post_data string")
    a, b = sg.detect_dynamic(responses, requests).orderBy("site").collect()
    assert (a.url, a.best_score, a.jobs_found, a.method, a.payload) == ("https://h/api?p=1", 12, 3, "POST", "q")
    assert a.confidence == 0.95 and (b.matched, b.confidence, b.best_score) == (False, 0.0, -3)


DET = "site string, detector string, matched boolean, usable boolean, jobs_found int, confidence double, best_score int"


def test_classify_sites(spark):
    rows = [
        ("a", "WORKDAY_API", True, True, 40, None, None), ("a", "DOM_BROWSER", True, True, 3, 2.0, None),
        ("b", "DYNAMIC_API", False, False, 5, 0.9, 5), ("b", "INTERACTIVE_DOM", True, False, 5, 0.9, None),
        ("c", "DYNAMIC_API", True, True, 5, 0.9, 4), ("c", "DOM_BROWSER", True, False, 5, 4.0, None),
    ]
    df = spark.createDataFrame(rows, DET)
    out = {r.site: (r.type, r.confidence) for r in sg.classify_sites(df).collect()}
    assert out == {"a": ("DOM_BROWSER", round(0.55 + 3 * 0.015, 2)), "b": ("DYNAMIC_API", 0.62), "c": ("UNKNOWN", 0.0)}
    by_priority = {r.site: r.type for r in sg.classify_sites(df, by="priority").collect()}
    assert by_priority == {"a": "WORKDAY_API", "b": "DYNAMIC_API", "c": "UNKNOWN"}


def test_site_confidence_is_rounded_on_the_binary_value(one):
    for n in range(0, 30):
        want = round(min(0.99, 0.55 + min(max(n, 1), 25) * 0.015), 2)
        assert one(sg.site_confidence(F.lit(n))) == want


def test_verdicts_fall_back(spark):
    fallback = spark.createDataFrame([(s, "SIMPLE_API", 0.7) for s in "abcde"], "site string, type string, confidence double")
    replies = spark.createDataFrame(
        [("a", '{"type": "DOM_BROWSER", "confidence": 3}'), ("b", '{"type": "OTHER"}'), ("c", "oops"), ("d", '```\n{"confidence": 0.4}\n```')],
        "site string, content string",
    )
    out = {r.site: (r.type, r.confidence) for r in sg.validate_verdicts(replies, fallback).collect()}
    assert out["a"] == ("DOM_BROWSER", 1.0) and out["d"] == ("UNKNOWN", 0.4)
    assert out["b"] == out["c"] == out["e"] == ("SIMPLE_API", 0.7)


def test_confidence_and_filled_fields(spark):
    df = spark.createDataFrame(
        [("t", "l", "d" * 301, "s", ["k"], "e"), ("t", "", "d" * 300, None, [], None)],
        "title string, location string, description string, salary string, skills array<string>, experience string",
    )
    assert [r.s for r in df.select(sg.confidence().alias("s")).collect()] == [8, 2]
    assert sg.needs_enrichment(df).count() == 1 and sg.needs_enrichment(df, force=True).count() == 2
    assert [r.filled_fields for r in sg.filled_fields(df, df.columns).collect()] == [6, 2]


def test_run_summary(spark):
    rows = [("success", 3), ("success", 0), ("skipped", 0), ("failed", 0), (None, None)]
    r = sg.run_summary(spark.createDataFrame(rows, "status string, jobs_found int")).first()
    assert (r.total_sites, r.successful, r.failed, r.skipped) == (5, 1, 3, 1)


def test_an_unknown_detector_has_no_priority(spark):
    rows = [("s", "OTHER", True, True, 3, 0.5, 0), ("s", "WORKDAY_API", True, True, 3, 0.5, 0)]
    found = spark.createDataFrame(rows, "site string, detector string, matched boolean, usable boolean, jobs_found int, confidence double, best_score int")
    for by in ("confidence", "priority"):
        assert sg.classify_sites(found, by=by).first().type == "WORKDAY_API"


def test_two_replies_give_one_row(spark):
    replies = spark.createDataFrame([("s", '{"type":"WORKDAY_API","confidence":0.5}'), ("s", "{}")], "site string, content string")
    base = spark.createDataFrame([("s", "UNKNOWN", 0.0)], "site string, type string, confidence double")
    assert sg.validate_verdicts(replies, base).count() == 1
