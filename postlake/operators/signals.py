"""Page signals, detectors, response scores, strategy choice and run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import jsonv as jv
from postlake.functions import lexicons as lex
from postlake.functions.terms import counts_in
from postlake.functions.text import any_contains, count_contains, let, lit_array, or_empty, strip
from postlake.operators.dedupe import dedupe_first, top_n_per
from postlake.operators.html import anchor_array
from postlake.operators.payloads import extract_listing_jobs, request_template, unfence


def _points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


# --- E1, E2, E21 ------------------------------------------------------------


def truthy(c: Column, kind: T.DataType) -> Column:
    """Not null, empty, zero or false, by type."""
    if isinstance(kind, T.StringType):
        test = c != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    elif isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def _score(get) -> Column:  # noqa: ANN001
    def text(name: str) -> Column:
        return F.coalesce(get(name) != "", F.lit(False))

    return (
        _points(text("title"), 2)
        + _points(text("location"), 1)
        + _points(F.length(or_empty(get("description"))) > 300, 2)
        + _points(text("salary"), 1)
        + _points(F.coalesce(F.size(get("skills")) > 0, F.lit(False)), 1)
        + _points(text("experience"), 1)
    )


def confidence() -> Column:
    """0-8 points for the record columns of a frame."""
    return _score(F.col)


def record_score(record: Column) -> Column:
    """0-8 points for a record struct."""
    return _score(lambda name: record[name])


def needs_enrichment(df: DataFrame, force: bool = False) -> DataFrame:
    return df if force else df.where(confidence() < 4)


def is_filled(c: Column, kind: T.DataType) -> Column:
    """Not null, not the empty string, not an empty list; zero and false count."""
    if isinstance(kind, T.StringType):
        test = c != ""
    elif isinstance(kind, T.ArrayType):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def filled_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    total = F.lit(0)
    for name in fields:
        total = total + _points(is_filled(F.col(name), df.schema[name].dataType), 1)
    return df.withColumn("filled_fields", total)


# --- E3 - E6 ----------------------------------------------------------------


def page_signals(
    pages: DataFrame,
    discovered: DataFrame | Column | None = None,
    page_id: str = "page_id",
    terms: Sequence[str] = lex.PAGE_TERMS,
    paging: Sequence[str] = lex.PAGING_TERMS,
    href_tokens: Sequence[str] = lex.LINK_HREF_TOKENS,
    label_tokens: Sequence[str] = lex.LINK_LABEL_TOKENS,
    url_tokens: Sequence[str] = lex.DISCOVERED_TOKENS,
    links: str | None = None,
) -> DataFrame:
    """Term, paging, link and discovered-URL counts per page, counted inside the row.

    ``discovered`` is a table (page_id, url), reduced to one count per page before it is joined, or
    a column with the array of a page's URLs, counted in the row. ``links`` names a column that holds the
    page's `anchor_array`, if it is at hand.
    """
    found_links = F.col(links) if links else anchor_array(F.col("html"))
    in_row = discovered if isinstance(discovered, Column) else F.array().cast("array<string>")
    text = F.regexp_replace(F.lower(or_empty(F.col("html"))), lex.TAG_PATTERN, " ")

    def is_job_link(a: Column) -> Column:
        label = F.lower(F.regexp_replace(a.inner, lex.TAG_PATTERN, " "))
        return any_contains(F.lower(a.href), href_tokens) | any_contains(label, label_tokens)

    kept = [c for c in pages.columns if c != "html"]
    counted = pages.select(
        *kept,
        counts_in(text, (terms, paging)).alias("_hits"),
        F.size(F.filter(found_links, is_job_link)).alias("job_link_count"),
        F.size(F.filter(in_row, lambda x: any_contains(F.lower(x), url_tokens))).cast("long").alias("browser_signal_count"),
    ).select(
        *kept, F.col("_hits")[0].alias("keyword_hits"), F.col("_hits")[1].alias("pagination_hits"),
        "job_link_count", "browser_signal_count",
    )
    if discovered is None or isinstance(discovered, Column):
        return counted
    counted = counted.drop("browser_signal_count")
    urls = discovered.groupBy(page_id).agg(
        F.count_if(any_contains(F.lower("url"), url_tokens)).alias("browser_signal_count")
    )
    return counted.join(urls, page_id, "left").withColumn(
        "browser_signal_count", F.coalesce("browser_signal_count", F.lit(0).cast("long"))
    )


def _count(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")) if name in df.columns else F.lit(0).cast("long")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _detect(df: DataFrame, usable_if: Column, points: Column, detector: str) -> DataFrame:
    links, anchors = _count(df, "job_link_count"), _count(df, "job_anchor_count")
    matched = (links >= 3) | (_count(df, "keyword_hits") >= 4) | (anchors >= 4)
    usable = matched & usable_if
    return df.withColumns(
        {
            "detector": F.lit(detector),
            "matched": matched,
            "usable": usable,
            "jobs_found": F.greatest(links, anchors),
            "confidence": F.when(usable, points).otherwise(0).cast("double"),
        }
    )


def detect_paged(signals: DataFrame) -> DataFrame:
    nexts, numbered = _count(signals, "next_controls"), _count(signals, "numbered_pagination")
    usable = (
        (_count(signals, "pagination_hits") > 0)
        | (_count(signals, "job_link_count") >= 5)
        | (_count(signals, "browser_signal_count") >= 3)
        | (nexts > 0)
        | (numbered > 0)
    )
    points = 2 + F.least(nexts, F.lit(2)) + F.least(numbered, F.lit(2))
    return _detect(signals, usable, points, "DOM_BROWSER")


def detect_load_more(signals: DataFrame) -> DataFrame:
    controls, growth = _count(signals, "load_more_controls"), _count(signals, "load_more_growth")
    usable = (controls > 0) & ((growth > 0) | _flag(signals, "load_more_clicked"))
    points = 4 + F.least(controls, F.lit(2)) + F.least(growth, F.lit(4))
    return _detect(signals, usable, points, "DOM_LOAD_MORE")


def detect_infinite(signals: DataFrame) -> DataFrame:
    growth, scrolls = _count(signals, "scroll_growth"), _flag(signals, "scrollable_container")
    controls = (
        _count(signals, "load_more_controls")
        + _count(signals, "next_controls")
        + _count(signals, "numbered_pagination")
    )
    usable = (growth > 0) | (scrolls & (controls == 0) & (_count(signals, "page_height_delta") > 0))
    points = 4 + F.least(growth, F.lit(4)) + _points(scrolls, 2)
    return _detect(signals, usable, points, "DOM_INFINITE_SCROLL")


# --- E7, E8 -----------------------------------------------------------------


def detect_interactive(
    probes: DataFrame,
    terms: Sequence[str] = lex.INTERACTIVE_TERMS,
    link_patterns: Sequence[str] = lex.INTERACTIVE_LINK_PATTERNS,
) -> DataFrame:
    """Growth, signal words and job links of a probe; unavailable probes never match."""
    ok = F.coalesce(F.col("available"), F.lit(False))
    first, last = F.length(or_empty(F.col("initial_html"))), F.length(or_empty(F.col("final_html")))
    any_link = "(?i)(?:" + "|".join(link_patterns) + ")"
    links = F.size(
        F.filter(
            F.regexp_extract_all(or_empty(F.col("final_html")), F.lit(lex.HREF_PATTERN), 1),
            lambda h: h.rlike(any_link),
        )
    )
    grown = (last.cast("double") - first) / F.greatest(first, F.lit(1)) * F.lit(0.1)
    slim = probes.withColumns(
        {
            "initial_html_length": F.when(ok, first).otherwise(0),
            "final_html_length": F.when(ok, last).otherwise(0),
            "dom_changed": ok & (first > 0) & (last > first * F.lit(1.3)),
            "job_signal_count": F.when(
                ok, let(F.lower("final_html"), lambda t: count_contains(t, terms))
            ).otherwise(0),
            "job_links_count": F.when(ok, F.greatest(links, F.col("job_links_count"))).otherwise(0),
            "_growth": grown,
        }
    ).drop("initial_html", "final_html")
    signals, found = F.col("job_signal_count"), F.col("job_links_count")
    matched = F.col("dom_changed") & ((signals >= 3) | (found >= 3))
    conf = F.least(
        F.lit(0.95),
        F.lit(0.40)
        + F.least(F.lit(0.4), F.col("_growth"))
        + F.least(F.lit(0.3), signals * F.lit(0.03))
        + F.least(F.lit(0.3), found * F.lit(0.02)),
    )
    return slim.withColumns(
        {
            "detector": F.lit("INTERACTIVE_DOM"),
            "matched": matched,
            "usable": matched,
            "jobs_found": F.when(matched, found).otherwise(0).cast("long"),
            "confidence": F.when(matched, conf).otherwise(0.0),
        }
    ).drop("_growth")


def dom_signal_deltas(snapshots: DataFrame, site: str = "site", phase: str = "phase") -> DataFrame:
    """Growth between the snapshots of a site: 0 first, 1 after load-more, 2 final."""

    def at(n: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(phase) == n, F.col(name))), F.lit(0))

    counts = snapshots.groupBy(site).agg(
        *[at(n, "job_anchor_count").alias(f"_a{n}") for n in (0, 1, 2)],
        *[at(n, "page_height").alias(f"_h{n}") for n in (0, 2)],
    )

    def grew(later: str, earlier: str) -> Column:
        return F.greatest(F.lit(0), F.col(later) - F.col(earlier))

    return counts.select(
        site,
        F.col("_a2").alias("job_anchor_count"),
        F.col("_h2").alias("page_height"),
        grew("_h2", "_h0").alias("page_height_delta"),
        grew("_a1", "_a0").alias("load_more_growth"),
        grew("_a2", "_a1").alias("scroll_growth"),
    )


# --- E9 - E14, E22 ----------------------------------------------------------


def response_score(
    body: Column,
    body_length: Column,
    terms: Sequence[str] = lex.RESPONSE_TERMS,
    paging: Sequence[str] = lex.RESPONSE_PAGING_TERMS,
) -> Column:
    def score(low: Column) -> Column:
        return (
            _points(count_contains(low, terms) >= 3, 3)
            + _points(low.contains("description"), 3)
            + _points(low.contains("title"), 2)
            + _points(low.contains("location"), 2)
            + _points(any_contains(low, paging), 2)
            + _points(body_length < 500, -3)
        )

    is_null = body.isNull() | (strip(body) == "null")
    return F.when(is_null, 0).otherwise(let(F.lower(body), score))


def score_responses(responses: DataFrame, **lists: Sequence[str]) -> DataFrame:
    """The table of all response scores."""
    return responses.withColumn("score", response_score(F.col("body"), F.col("body_length"), **lists))


def estimate_jobs(body: Column) -> Column:
    """Job count of a payload: list length, counted total, or job-like objects."""

    def of(v: Column) -> Column:
        lists = [F.when(jv.is_array(jv.field(v, k)), F.size(jv.as_list(jv.field(v, k)))) for k in lex.COUNT_LIST_KEYS]
        totals = [
            F.when(jv.text_of(jv.field(v, k)).rlike(r"^-?\d+$"), jv.as_text(jv.field(v, k)).cast("int")).when(
                jv.text_of(jv.field(v, k)) == "true", 1
            ).when(jv.text_of(jv.field(v, k)) == "false", 0)
            for k in lex.COUNT_TOTAL_KEYS
        ]

        def has(value: Column, *names: str) -> Column:
            found = F.lit(False)
            for name in names:
                found = found | jv.field(value, name).isNotNull()
            return found

        def like(value: Column) -> Column:
            head = F.try_element_at(jv.as_list(value), F.lit(1))
            return (
                F.when(jv.is_object(value) & has(value, "title", "location", "job_title"), 1)
                .when(jv.is_array(value) & jv.is_object(head) & has(head, "title", "location"), F.size(jv.as_list(value)))
                .otherwise(0)
            )

        job_like = F.aggregate(F.map_values(jv.as_map(v)), F.lit(0), lambda acc, x: acc + like(x))
        return F.coalesce(
            F.when(jv.is_array(v), F.size(jv.as_list(v))),
            F.when(jv.is_object(v), F.coalesce(*lists, *totals, job_like)),
            F.lit(0),
        )

    return let(jv.parse(body), of)


def detect_dynamic(
    responses: DataFrame, requests: DataFrame, site: str = "site", threshold: int = 5, **lists: Sequence[str]
) -> DataFrame:
    """Best response per site, the first on ties, with its request template.

    All scores stay in the `score_responses` table instead of a list per site, which would
    have no bound. Only the best response of each site is counted and joined.
    """
    scored = score_responses(responses, **lists)
    best = top_n_per(scored, [site], [F.desc("score"), "seq"], 1)
    ok = F.col("score") >= threshold
    judged = best.select(
        site,
        "url",
        F.col("score").alias("best_score"),
        ok.alias("matched"),
        ok.alias("usable"),
        F.when(ok, estimate_jobs(F.col("body"))).otherwise(0).cast("long").alias("jobs_found"),
        F.when(ok, F.least(F.lit(0.95), F.lit(0.50) + F.col("score") * F.lit(0.05)))
        .otherwise(0.0)
        .alias("confidence"),
    ).withColumn("detector", F.lit("DYNAMIC_API"))
    return request_template(judged, requests, site)


def validate_endpoints(responses: DataFrame, base: str = "base_url", body: str = "body") -> DataFrame:
    """Accept or reject captured JSON endpoints; ``reason`` names the first failed test."""
    text = F.col(body)

    def hits(terms: Sequence[str]) -> Column:
        return let(F.lower(text), lambda low: count_contains(low, terms))

    is_json = F.lower(or_empty(F.col("content_type"))).contains("json")
    v = jv.parse(text)
    with_jobs = extract_listing_jobs(responses, base, body)
    n = F.size("jobs")
    reason = (
        F.when(F.col("status") >= 400, F.lit("http_error"))
        .when(~is_json, F.lit("not_json"))
        .when(v.isNull(), F.lit("json_parse_failed"))
        .when(jv.text_of(v).isin("null", "{}", "[]"), F.lit("empty_payload"))
        .when(n == 1, F.lit("single_job_endpoint"))
        .when(hits(lex.ENDPOINT_UI_TERMS) >= 2, F.lit("ui_navigation_payload"))
        .when(
            ~(F.col("has_list_key") | F.col("from_list") | (hits(lex.ENDPOINT_TERMS) >= 3)),
            F.lit("missing_job_structure"),
        )
        .when(n == 0, F.lit("no_job_like_fields"))
        .otherwise(F.lit("accepted"))
    )
    score = (
        _points(F.col("has_list_key"), 2)
        + _points(n > 5, 2)
        + _points(any_contains(F.lower(text), lex.ENDPOINT_PAGING_TERMS), 1)
        + _points(F.col("has_fields"), 1)
    )
    return (
        with_jobs.withColumn("reason", reason)
        .withColumn("accepted", F.col("reason") == "accepted")
        .withColumn("score", F.when(F.col("accepted"), score).otherwise(0))
        .withColumn("jobs_found", F.when(F.col("accepted"), n).otherwise(0))
    )


def best_endpoint(validated: DataFrame, site: str = "site", rank: str = "rank") -> DataFrame:
    """Accepted endpoint with the highest score per site, the first on ties."""
    # Rejected rows have a null order, which max_by skips; a filter here would be pushed down
    # and would evaluate the whole payload walk twice.
    order = F.when(F.col("accepted"), F.struct(F.col("score"), -F.col(rank)))
    return (
        validated.groupBy(site)
        .agg(
            F.max_by(F.struct("url", "score", "jobs_found"), order).alias("b"),
            F.max("accepted").alias("_any"),
        )
        .where("_any")
        .select(
            site,
            F.lit("SIMPLE_API").alias("detector"),
            F.lit(True).alias("matched"),
            F.lit(True).alias("usable"),
            F.col("b.jobs_found").cast("long").alias("jobs_found"),
            F.col("b.url").alias("api_url"),
            F.col("b.score").cast("double").alias("confidence"),
        )
    )


def detect_platform(
    postings: DataFrame, detector: str, site: str = "site", endpoint: str = "endpoint", rank: str = "rank"
) -> DataFrame:
    """First endpoint with postings per site and how many it has."""
    counts = postings.groupBy(site, endpoint, rank).agg(F.count("*").alias("n"))
    return (
        counts.groupBy(site)
        .agg(F.min_by(F.struct(endpoint, "n"), rank).alias("b"))
        .select(
            site,
            F.lit(detector).alias("detector"),
            F.lit(True).alias("matched"),
            F.lit(True).alias("usable"),
            F.col("b.n").alias("jobs_found"),
            F.col(f"b.{endpoint}").alias("api_url"),
            F.lit(0.0).alias("confidence"),
        )
    )


def has_paging(body: Column) -> Column:
    """Paging names among the top-level keys."""
    return F.coalesce(
        F.arrays_overlap(F.json_object_keys(body), lit_array(lex.PAGING_OBJECT_KEYS)), F.lit(False)
    )


def mentions_paging(body: Column) -> Column:
    """Paging names anywhere in the payload text."""
    return any_contains(F.lower(or_empty(body)), lex.ENDPOINT_PAGING_TERMS)


# --- E15 - E17 --------------------------------------------------------------

# Site confidence for 1 to 25 jobs, rounded on the exact binary value; Spark's own rounding
# differs in the last digit for 5, 19 and 21.
SITE_CONFIDENCE = tuple(round(min(0.99, 0.55 + n * 0.015), 2) for n in range(1, 26))


def site_confidence(jobs_found: Column) -> Column:
    steps = F.array(*[F.lit(x) for x in SITE_CONFIDENCE])
    return F.element_at(steps, F.least(F.greatest(jobs_found, F.lit(1)), F.lit(25)).cast("int"))


def classify_sites(
    detections: DataFrame, site: str = "site", by: str = "confidence", types: Sequence[str] = lex.SITE_TYPES
) -> DataFrame:
    """Best viable detector per site; sites without one are UNKNOWN.

    Ranked by confidence, jobs found and priority, or by priority alone. One map-side
    combined maximum per site; no ordering of a site's rows.
    """
    viable = (
        F.when(F.col("detector") == "DYNAMIC_API", F.coalesce(F.col("best_score"), F.lit(0)) >= 5)
        .when(F.col("detector") == "INTERACTIVE_DOM", F.col("matched"))
        .otherwise(F.col("matched") & F.col("usable"))
    )
    place = F.array_position(lit_array(types), F.col("detector"))
    priority = F.when(place > 0, F.lit(len(types)) - place).otherwise(F.lit(0))  # 0 for an unknown name too
    if by == "priority":
        order = F.struct(priority)
    else:
        order = F.struct(
            F.coalesce(F.col("confidence"), F.lit(0.0)),
            F.coalesce(F.col("jobs_found").cast("long"), F.lit(0).cast("long")),
            priority,
        )
    picked = (
        detections.groupBy(site)
        .agg(
            F.max_by(F.struct("detector", "jobs_found"), F.when(F.coalesce(viable, F.lit(False)), order)).alias("b"),
            F.max(F.coalesce(viable, F.lit(False))).alias("_any"),
        )
    )
    return picked.select(
        site,
        F.when(F.col("_any"), F.col("b.detector")).otherwise(lex.UNKNOWN).alias("type"),
        F.when(F.col("_any"), site_confidence(F.col("b.jobs_found"))).otherwise(0.0).alias("confidence"),
    )


def validate_verdicts(
    replies: DataFrame, fallback: DataFrame, site: str = "site", order: Sequence[str] = ("content",)
) -> DataFrame:
    """Classification replies that name a known type; all others take the fallback.

    Of several replies for a site the first by ``order`` counts.
    """
    replies = dedupe_first(replies, [site], list(order))
    parsed = jv.parse(unfence(F.col("content")))
    kind = jv.field(F.col("_v"), "type")
    score = jv.field(F.col("_v"), "confidence")
    name = F.when(kind.isNull(), F.lit(lex.UNKNOWN)).otherwise(
        F.when(jv.is_string(kind), jv.as_text(kind))
    )
    number = F.when(score.isNull(), F.lit(0.0)).otherwise(jv.as_text(score).try_cast("double"))
    read = replies.withColumn("_v", F.when(jv.is_object(parsed), parsed)).select(
        site, F.when(F.col("_v").isNotNull(), name).alias("_type"), F.when(F.col("_v").isNotNull(), number).alias("_conf")
    )
    good = F.coalesce(F.col("_type").isin(*lex.SITE_TYPES, lex.UNKNOWN) & F.col("_conf").isNotNull(), F.lit(False))
    return fallback.join(read, site, "left").select(
        site,
        F.when(good, F.col("_type")).otherwise(F.col("type")).alias("type"),
        F.when(good, F.greatest(F.lit(0.0), F.least(F.col("_conf"), F.lit(1.0))))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        good.alias("from_reply"),
    )


def strategy(site_type: Column) -> Column:
    return F.when(site_type.contains("API"), F.lit("api")).otherwise("dom")


# --- E18 - E20 --------------------------------------------------------------


def run_status(jobs_found: Column, site_type: Column) -> Column:
    return (
        F.when(site_type == lex.UNKNOWN, F.lit("skipped"))
        .when(jobs_found > 0, F.lit("success"))
        .otherwise("failed")
    )


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    good = F.coalesce((F.col("status") == "success") & (F.col("jobs_found") > 0), F.lit(False))
    skipped = F.coalesce(~good & (F.col("status") == "skipped"), F.lit(False))
    return results.groupBy(*by).agg(
        F.count("*").alias("total_sites"),
        F.count_if(good).alias("successful"),
        F.count_if(~good & ~skipped).alias("failed"),
        F.count_if(skipped).alias("skipped"),
    )


def token_totals(details: DataFrame, by: str = "domain") -> DataFrame:
    return details.groupBy(by).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))


def sample_counts(details: DataFrame, by: str = "domain") -> DataFrame:
    """Jobs per domain, and one row with a null domain for all of them."""
    return details.rollup(by).agg(F.count("*").alias("jobs_count"))


