"""The two whole runs on small tables."""

from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.operators import flows
from postlake.sources import io

FOUND = "site string, detector string, matched boolean, usable boolean, jobs_found long, confidence double"
RUNS = "site string, url string, final_url string, seq long"
LISTED = "site string, detector string, pos int, title string, location string, url string"


def test_every_kind_of_detector_can_be_chosen(spark):
    found = [spark.createDataFrame([(k, k, True, True, 2, 0.5)], FOUND) for k in lex.SITE_TYPES if k != "DYNAMIC_API"]
    scored = spark.createDataFrame([("DYNAMIC_API", "DYNAMIC_API", 9)], "site string, detector string, best_score long")
    table = flows.detection_table(*found, scored)
    assert table.columns == ["site", *flows.DETECTION]
    runs = spark.createDataFrame([(k, f"https://{k}", f"https://{k}", i) for i, k in enumerate(lex.SITE_TYPES)], RUNS)
    listings = spark.createDataFrame([(k, d, 0, f"Job {d}", "", "/j/1") for k in lex.SITE_TYPES for d in lex.SITE_TYPES], LISTED)
    empty = (spark.createDataFrame([], io.SITES_SCHEMA), spark.createDataFrame([], io.JOBS_SCHEMA))
    run = flows.scrape_sites(*empty, runs, table, listings)
    assert {r.site: r.type for r in run.results.collect()} == {k: k for k in lex.SITE_TYPES}
    titles = {r.title for r in run.jobs.collect()}
    assert titles == {f"Job {k}" for k in lex.SITE_TYPES}
    assert run.jobs.join(run.sites.withColumnRenamed("id", "site_id"), "site_id").count() == 8


def test_refused_and_unknown_sites_save_nothing(spark):
    sites = spark.createDataFrame([(1, "a", "X", 0.1), (2, "b", "X", 0.1)], io.SITES_SCHEMA)
    jobs = spark.createDataFrame([(5, 1, "kept", "", "/k", "{}")], io.JOBS_SCHEMA)
    runs = spark.createDataFrame([("p", "a", "b", 1), ("q", "n", "n", 2), ("r", "z", "z", 3)], RUNS)
    found = spark.createDataFrame([("p", "DOM_BROWSER", True, True, 1, 2.0), ("q", "SIMPLE_API", True, True, 3, 2.0)], FOUND)
    listings = spark.createDataFrame(
        [("p", "DOM_BROWSER", 0, "T", "", "/1"), ("q", "SIMPLE_API", 0, "", "", "/2"), ("q", "SIMPLE_API", 1, "Q", "", "/3"), ("r", "UNKNOWN", 0, "R", "", "/4")],
        LISTED,
    )
    run = flows.scrape_sites(sites, jobs, runs, flows.detection_table(found), listings)
    got = {r.site: (r.type, r.status, r.jobs_found, r.site_id is None) for r in run.results.collect()}
    assert got == {"p": ("DOM_BROWSER", "refused", 1, True), "q": ("SIMPLE_API", "success", 2, False), "r": ("UNKNOWN", "skipped", 0, False)}
    assert sorted(r.title for r in run.jobs.collect()) == ["Q", "kept"]
    assert sorted(r.domain for r in run.sites.collect()) == ["a", "b", "n", "z"]


def test_a_site_that_moves_on_keeps_its_jobs(spark):
    none = spark.createDataFrame([], io.SITES_SCHEMA), spark.createDataFrame([], io.JOBS_SCHEMA)
    runs = spark.createDataFrame([("p", "n", "m", 1), ("q", "m", "m2", 2)], RUNS)
    found = spark.createDataFrame([(s, "DOM_BROWSER", True, True, 1, 2.0) for s in "pq"], FOUND)
    listings = spark.createDataFrame([("p", "DOM_BROWSER", 0, "P", "", "/1"), ("q", "DOM_BROWSER", 0, "Q", "", "/1")], LISTED)
    run = flows.scrape_sites(*none, runs, flows.detection_table(found), listings)
    assert [r.domain for r in run.sites.collect()] == ["m2"]
    assert [(r.title, r.url) for r in run.jobs.collect()] == [("Q", "/1")]


def test_details_of_missing_pages_are_empty_records(spark):
    saved = spark.createDataFrame(
        [("d", "DOM_BROWSER", "2", i, f"T{i}", "L", f"https://h/{i}", None) for i in range(7)] + [("d", "DOM_BROWSER", "1", 0, "old", "L", "https://h/old", None)],
        "domain string, site_type string, timestamp string, pos int, title string, location string, url string, raw string",
    )
    pages = spark.createDataFrame([("https://h/0", "<h1>Page title</h1>"), ("https://h/0", "<h1>Zz</h1>")], "url string, html string")
    got = flows.detail_jobs(saved, pages).orderBy("pos").collect()
    assert [(r.pos, r.title, r.job_link) for r in got] == [(0, "Page title", "https://h/0")] + [(i, "", f"https://h/{i}") for i in range(1, 5)]
    assert all(r.ai_usage.total_tokens == 0 for r in got)
    replies = spark.createDataFrame([("https://h/0", '{"required_skills": ["SQL"]}', 9)], "url string, content string, total_tokens long")
    told = flows.detail_jobs(saved, pages, replies.withColumns({"prompt_tokens": F.lit(5), "completion_tokens": F.lit(4)})).where("pos = 0").first()
    assert told.required_skill_set == ["SQL"] and told.ai_usage.total_tokens == 9
