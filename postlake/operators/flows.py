"""The two whole runs, put together from the operators.

`scrape_sites` takes what the detectors found, chooses a strategy per site, takes the listings of
the chosen kind and applies both to the site and job tables. `detail_jobs` takes saved listings to
detail records.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.operators import merge as mg
from postlake.operators.dedupe import latest_per, top_n_per
from postlake.operators.payloads import enrich_from_raw
from postlake.operators.records import extract_details
from postlake.operators.signals import classify_sites, run_status, strategy, validate_verdicts
from postlake.operators.sites import applied, resolve_runs
from postlake.session import stored

#: Columns of the long detection table and their types.
DETECTION = {
    "detector": "string", "matched": "boolean", "usable": "boolean", "jobs_found": "long", "confidence": "double",
    "best_score": "long", "api_url": "string",
}


def detection_table(*found: DataFrame, site: str = "site") -> DataFrame:
    """What all detectors found as one long table; a column that a detector has not is null."""
    parts = [
        df.select(site, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in DETECTION.items()])
        for df in found
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


class SiteRun(NamedTuple):
    """New states of the two tables, and one result per run."""

    sites: DataFrame
    jobs: DataFrame
    results: DataFrame


def _site_ids(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """The site id of every run that was not refused, by the run's own columns.

    A site that the batch added is found by the domain that its last run gave it.
    """
    done = resolved.where("outcome <> 'refused'")
    last = done.where(F.col("id").isNull()).groupBy("added_by").agg(F.max_by("final_url", "seq").alias("domain"))
    new = last.join(sites.select("domain", F.col("id").alias("_new")), "domain").select("added_by", "_new")
    return done.join(new, "added_by", "left").select("seq", "url", "final_url", F.coalesce("id", "_new").alias("site_id"))


def scrape_sites(
    sites: DataFrame,
    jobs: DataFrame,
    runs: DataFrame,
    detections: DataFrame,
    listings: DataFrame,
    postings: DataFrame | None = None,
    replies: DataFrame | None = None,
    site: str = "site",
) -> SiteRun:
    """Sites detected, chosen, listed and saved.

    ``runs(site, url, final_url, seq)`` has one row per site, ``listings(site, detector, pos, title, location,
    url)`` what each kind of scraper would list, ``postings(site, url, pos, raw)`` the raw objects of
    API sites, ``replies(site, content)`` a model's verdicts, which win where they are valid. A site
    without a usable detector is UNKNOWN and skipped. A run that would give two sites one domain is
    refused, and its listings are not saved.
    """
    chosen = classify_sites(detections, site)
    every = runs.select(site).distinct().join(chosen, site, "left").select(
        site, F.coalesce("type", F.lit(lex.UNKNOWN)).alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )
    if replies is not None:
        every = validate_verdicts(replies, every, site).drop("from_reply")
    verdicts = stored(every, "verdicts")
    named = stored(runs.join(verdicts, site), "runs")
    resolved = stored(resolve_runs(sites, named), "resolved")
    after = stored(applied(sites, resolved), "sites")
    own = ["seq", "url", "final_url"]
    placed = named.join(_site_ids(after, resolved), own, "left")

    kind = placed.select(site, "site_id", "seq", F.col("type").alias("detector"))
    listed = listings.join(kind, [site, "detector"]).where(F.col("detector") != lex.UNKNOWN)
    counts = listed.groupBy(site).agg(F.count("*").alias("jobs_found"))
    results = placed.join(counts, site, "left").withColumn("jobs_found", F.coalesce("jobs_found", F.lit(0).cast("long")))
    status = F.when(
        F.col("site_id").isNull(), F.lit("refused")
    ).otherwise(run_status(F.col("jobs_found"), F.col("type")))

    kept = listed.where(F.col("site_id").isNotNull())
    if postings is not None:
        kept = mg.attach_raw(kept, postings, (site, "url"))
    own_object = F.to_json(F.struct("title", "location", "url"))
    raw = F.when(strategy(F.col("detector")) == "api", F.col("raw")) if postings is not None else F.lit(None)
    batch = kept.select(
        F.struct("seq", "pos").alias("order"), "site_id", "title", "location", "url", F.coalesce(raw, own_object).alias("raw_json")
    )
    return SiteRun(
        after,
        mg.upsert_jobs(jobs, batch, "order"),
        results.select(
            site, "site_id", "type", "confidence", "jobs_found", status.alias("status"), strategy(F.col("type")).alias("strategy")
        ),
    )


def detail_jobs(saved: DataFrame, pages: DataFrame, replies: DataFrame | None = None, per_site: int = 5) -> DataFrame:
    """Detail records of the first jobs of each site's newest saved run.

    ``saved(domain, site_type, timestamp, pos, title, location, url, raw)`` are listings as the sinks
    saved them, ``pages(url, html)`` captured job pages (the first of a URL counts), ``replies(url,
    content, ...)`` the model's answers about them. API sites take their details from the raw object
    and never from a page, other sites from the page alone; a page that is missing leaves an empty
    record. Adds domain, site_type, strategy and the position in the run.
    """
    newest = top_n_per(latest_per(saved, ["domain"], "timestamp"), ["domain"], ["pos"], per_site)
    routed = stored(newest.withColumn("strategy", strategy(F.col("site_type"))), "listings")
    facts = ["domain", "site_type", "strategy", "pos"]

    api = mg.to_record_api(enrich_from_raw(routed.where("strategy = 'api'")), keep=facts)

    asked = routed.where("strategy = 'dom'").select("url").distinct()
    html = pages.groupBy("url").agg(F.min("html").alias("html"))
    wanted = asked.join(html, "url").select(F.col("url").alias("page_id"), "html")
    answers = replies.withColumnRenamed("url", "page_id") if replies is not None else None
    details = extract_details(wanted, answers, force=True).withColumnRenamed("page_id", "url")
    from_dom = routed.where("strategy = 'dom'").select(*facts, "url").join(details, "url", "left")
    return api.unionByName(mg.to_record_dom(from_dom, keep=facts))
