"""Runs applied to the site table, against applying them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import merge as mg
from postlake.operators import sites as si

SITES = "id long, domain string, type string, confidence double"
RUNS = "url string, final_url string, type string, confidence double, seq long"


def one_by_one(sites, runs):
    """Rows [key, domain, type, confidence] and the outcomes by seq."""
    held, outcomes = [list(s) for s in sites], {}
    for url, final, kind, confidence, seq in sorted(runs, key=lambda r: r[4]):
        given = next((s for s in held if s[1] == url), None)
        ended = next((s for s in held if s[1] == final), None)
        if given and ended and given is not ended:
            outcomes[seq] = "refused"
            continue
        outcomes[seq] = "moved" if given and url != final else "updated" if ended else "added"
        site = given or ended
        if site is None:
            site = [None, *[None] * 3]
            held.append(site)
        site[1:] = [final, kind, confidence]
    return held, outcomes


def check(spark, sites, runs):
    resolved = si.resolve_runs(spark.createDataFrame(sites, SITES), spark.createDataFrame(runs, RUNS))
    held, outcomes = one_by_one(sites, runs)
    assert {r.seq: r.outcome for r in resolved.collect()} == outcomes
    got = si.applied(spark.createDataFrame(sites, SITES), resolved).collect()
    ids = {s[0] for s in sites}
    assert sorted((r.id if r.id in ids else -1, r.domain, r.type) for r in got) == sorted(
        (s[0] if s[0] is not None else -1, s[1], s[2]) for s in held
    )
    assert len({r.id for r in got}) == len({r.domain for r in got}) == len(got)
    return got, outcomes


def test_given_url_comes_first(spark):
    sites = [(1, "https://a", "X", 0.1), (2, "https://b", "X", 0.1)]
    runs = [
        ("https://a", "https://a2", "T1", 0.5, 1), ("b", "https://b", "T2", 0.6, 2),
        ("https://n", "https://n2", "UNKNOWN", 0.0, 3), ("https://n", "https://n2", "T4", 0.9, 4),
    ]
    got, outcomes = check(spark, sites, runs)
    assert outcomes == {1: "moved", 2: "updated", 3: "added", 4: "updated"}
    assert len(got) == 3


def test_a_run_continues_an_earlier_one_of_the_batch(spark):
    got, _ = check(spark, [(7, "z", "X", 0.1)], [("n", "m", "A", 0.1, 1), ("m", "m2", "B", 0.2, 2)])
    assert sorted(r.domain for r in got) == ["m2", "z"]


def test_a_known_domain_is_not_taken_over(spark):
    sites = [(1, "a", "T", 0.1), (2, "b", "T", 0.2)]
    got, outcomes = check(spark, sites, [("a", "b", "N", 0.9, 1)])
    assert outcomes == {1: "refused"} and sorted((r.id, r.domain) for r in got) == [(1, "a"), (2, "b")]
    runs = spark.createDataFrame([("a", "b", "N", 0.9, 1)], RUNS)
    refused = si.refused_runs(si.resolve_runs(spark.createDataFrame(sites, SITES), runs)).collect()
    assert [(r.url, r.final_url) for r in refused] == [("a", "b")]


def test_every_job_still_finds_its_site(spark):
    sites = [(1, "a", "T", 0.1), (2, "b", "T", 0.2), (3, "c", "T", 0.3)]
    runs = [("a", "b", "N", 0.9, 1), ("b", "x", "N", 0.9, 2), ("a", "b", "N", 0.9, 3), ("c", "x", "N", 0.9, 4)]
    check(spark, sites, runs)
    known = si.upsert_sites(spark.createDataFrame(sites, SITES), spark.createDataFrame(runs, RUNS))
    jobs = spark.createDataFrame([(i, i % 3 + 1, "t", "l", f"u{i}", "{}") for i in range(30)], "id long, site_id long, title string, location string, url string, raw_json string")
    assert mg.site_jobs(jobs, known).count() == 30


@pytest.mark.parametrize("seed", range(6))
def test_random_runs(spark, seed):
    rng = random.Random(seed)
    names = [f"d{i}" for i in range(6 if seed % 2 else 40)]
    known = rng.sample(names, 4)
    sites = [(i + 1, d, "X", 0.0) for i, d in enumerate(known)]
    runs = [(rng.choice(names), rng.choice(names), f"T{i}", i / 10, i * 3) for i in range(150)]
    check(spark, sites, runs)


def test_a_chain_of_a_thousand_moves(spark):
    runs = [(f"d{i}", f"d{i + 1}", f"T{i}", 0.5, i) for i in range(1000)]
    got, outcomes = check(spark, [(1, "d0", "X", 0.1)], runs)
    assert [(r.id, r.domain, r.type) for r in got] == [(1, "d1000", "T999")] and set(outcomes.values()) == {"moved"}


def test_a_hot_name_of_refused_runs(spark):
    sites = [(1, "a", "X", 0.1), (2, "b", "X", 0.1)]
    runs = [("a", "b", "T", 0.5, i) for i in range(1000)] + [("b", "c", "M", 0.5, 1000), ("a", "b", "L", 0.5, 1001)]
    got, outcomes = check(spark, sites, runs)
    assert sorted((r.id, r.domain) for r in got) == [(1, "b"), (2, "c")] and outcomes[999] == "refused"


def test_odd_runs(spark):
    sites = spark.createDataFrame([(1, "a", "X", 0.1)], SITES)
    rows = [(None, "a", "T", 0.1, 1), ("a", None, "T", 0.1, 2), ("a", "b", "T", 0.1, None), ("a", "b", "T", 0.1, None), ("n", "n", None, None, 5)]
    got = si.upsert_sites(sites, spark.createDataFrame(rows, RUNS))
    assert sorted((r.domain, r.type) for r in got.collect()) == [("b", "T"), ("n", None)]
    assert si.upsert_sites(sites, spark.createDataFrame([], RUNS)).collect() == sites.collect()
    empty = si.upsert_sites(sites.limit(0), spark.createDataFrame(rows[2:3], RUNS).withColumn("x", F.lit(1)))
    assert [r.domain for r in empty.collect()] == ["b"]


def test_runs_are_numbered_in_order(spark):
    """Rounds shuffle these numbers, not digests: they stay small and order the runs, equal seq by a fixed tie."""
    rows = [("a", f"f{i % 50}", "T", 0.5, i // 3) for i in range(300)] + [("a", "b", "T", 0.1, None)]
    runs = spark.createDataFrame(rows, RUNS)
    sites = spark.createDataFrame([(1, "a", "X", 0.1)], SITES)
    one, two = (sorted(si.resolve_runs(sites, r).collect(), key=lambda r: r.run) for r in (runs, runs.orderBy(F.rand(1)).repartition(7)))
    assert all(isinstance(r.run, int) for r in one) and len({r.run for r in one}) == 301
    assert [r.seq for r in one] == sorted(r.seq for r in one)
    assert [(r.final_url, r.outcome, r.id) for r in one] == [(r.final_url, r.outcome, r.id) for r in two]
