"""Detector, strategy and run-total queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.functions import urls as u
from postlake.operators import html as h
from postlake.operators import signals as sg
from postlake.operators.dedupe import top_n_per
from postlake.plans.registry import Tables, query
from postlake.plans.url_queries import ANCHOR_SQL, DOMAIN_SQL, ORIGIN_SQL
from postlake.session import stored

# Words that occur in the invented pages.
PAGE_TERMS = ("license", "que", "thing", "ouch", "edit")
PAGING = ("tion the", "de la", "le les")
HREFS, LABELS, FOUND = ("tion", "eau"), ("an", "ing"), ("th", "page")


def sum_sql(column: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"contains({column}, '{t}')::INTEGER" for t in terms)


SIGNALS_SQL = rf"""{ANCHOR_SQL},
  links AS (SELECT page_id, count(*) AS n FROM anchors
    WHERE regexp_matches(lower(href), '{"|".join(HREFS)}') OR regexp_matches(lower(label), '{"|".join(LABELS)}') GROUP BY 1),
  urls AS (SELECT page_id, count(*) FILTER (regexp_matches(lower({ORIGIN_SQL} || href), '{"|".join(FOUND)}')) AS n FROM anchors GROUP BY 1),
  signals AS (SELECT p.page_id, url, ({sum_sql("t", PAGE_TERMS)})::BIGINT AS keyword_hits, ({sum_sql("t", PAGING)})::BIGINT AS pagination_hits,
      coalesce(links.n, 0) AS job_link_count, coalesce(urls.n, 0) AS browser_signal_count
    FROM (SELECT page_id, url, regexp_replace(lower(html), '<[^>]+>', ' ', 'g') AS t FROM pages) p
    LEFT JOIN links USING (page_id) LEFT JOIN urls USING (page_id))"""


TERMS = {"terms": PAGE_TERMS, "paging": PAGING, "href_tokens": HREFS, "label_tokens": LABELS, "url_tokens": FOUND}


def page_signals(t: Tables) -> DataFrame:
    found = h.anchors(t.pages, keep=["url"]).select(
        "page_id", F.concat(u.get_origin(F.col("url")), F.col("href")).alias("url")
    )
    return sg.page_signals(t.pages, found, **TERMS)


SIGNAL_COLUMNS = ("page_id", "keyword_hits", "pagination_hits", "job_link_count", "browser_signal_count")


@query("page_signals", f"WITH {SIGNALS_SQL} SELECT {', '.join(SIGNAL_COLUMNS)} FROM signals")
def _(t: Tables) -> DataFrame:
    return page_signals(t).select(*SIGNAL_COLUMNS)


PAGED_SQL = f"""{SIGNALS_SQL},
  m AS (SELECT *, job_link_count >= 3 OR keyword_hits >= 4 AS matched FROM signals),
  paged AS (SELECT *, matched AND (pagination_hits > 0 OR job_link_count >= 5 OR browser_signal_count >= 3) AS usable FROM m)"""


@query(
    "detect_paged",
    f"""WITH {PAGED_SQL} SELECT page_id, matched, usable, job_link_count AS jobs_found,
      CASE WHEN usable THEN 2 ELSE 0 END::DOUBLE AS confidence FROM paged""",
)
def _(t: Tables) -> DataFrame:
    return sg.detect_paged(page_signals(t)).select("page_id", "matched", "usable", "jobs_found", "confidence")


@query(
    "site_overview",
    rf"""WITH {PAGED_SQL},
      sites AS (SELECT {DOMAIN_SQL} AS domain, count(*) AS pages, sum(keyword_hits)::BIGINT AS keyword_hits,
          sum(job_link_count)::BIGINT AS job_links, bool_or(usable) AS usable FROM paged GROUP BY 1),
      ranked AS (SELECT {DOMAIN_SQL} AS domain, {ORIGIN_SQL} || href AS link,
          row_number() OVER (PARTITION BY {DOMAIN_SQL} ORDER BY page_id, pos) AS link_rank FROM anchors)
      SELECT domain, pages, keyword_hits, job_links, usable, link_rank, link
      FROM sites LEFT JOIN (SELECT * FROM ranked WHERE link_rank <= 5) USING (domain)""",
)
def _(t: Tables) -> DataFrame:
    """Per domain: page, term and link counts, the usable flag and the first five links.

    One pass over the pages gives their counts and their own first five links, which is all that a
    domain's first five can come from; what it gives is small and is grouped twice.
    """
    domain = u.get_domain(F.col("url")).alias("domain")
    pages = t.pages.withColumn("links", h.anchor_array(F.col("html")))
    urls = F.transform("links", lambda a: F.concat(u.get_origin(F.col("url")), a.href))
    firsts = F.transform(F.slice("links", 1, 5), lambda a, i: F.struct(i.alias("pos"), a.href.alias("href")))
    detected = sg.detect_paged(sg.page_signals(pages, urls, links="links", **TERMS))
    seen = stored(detected.withColumns({"domain": domain, "firsts": firsts}).drop("links"), "signals")
    sites = seen.groupBy("domain").agg(
        F.count("*").alias("pages"),
        F.sum("keyword_hits").alias("keyword_hits"),
        F.sum("job_link_count").alias("job_links"),
        F.max("usable").alias("usable"),
    )
    links = seen.select("domain", "url", "page_id", F.explode("firsts").alias("x")).select("domain", "url", "page_id", "x.*")
    top = top_n_per(links, ["domain"], ["page_id", "pos"], 5)
    ranks = top.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("page_id", "pos", "url", "href"))).alias("l"))
    first = ranks.select("domain", F.posexplode("l").alias("i", "x")).select(
        "domain",
        (F.col("i") + 1).alias("link_rank"),
        u.absolutize_url(F.col("x.url"), F.col("x.href")).alias("link"),
    )
    return sites.join(first, "domain", "left")


# Browser signals from the event stream: one site per user, counts per kind of event.
DOM_SQL = """dom AS (SELECT user_id AS site, count(*) FILTER (event_type = 'click') // 12 AS load_more_controls,
    count(*) FILTER (event_type = 'view') // 14 AS next_controls, count(*) FILTER (event_type = 'error') // 16 AS numbered_pagination,
    count(*) FILTER (value > 90) // 2 AS load_more_growth, count(*) FILTER (value < 5) // 3 AS scroll_growth,
    user_id % 3 = 0 AS scrollable_container, user_id % 5 = 0 AS load_more_clicked, count(*) % 7 AS job_anchor_count,
    count(*) % 11 AS page_height_delta FROM events GROUP BY user_id),
  base AS (SELECT *, job_anchor_count >= 4 AS matched FROM dom)"""


def dom_signals(t: Tables) -> DataFrame:
    def part(test: Column, by: int) -> Column:
        return F.floor(F.count_if(test) / by)

    kind, value, site = F.col("event_type"), F.col("value"), F.col("site")
    counted = t.events.groupBy(F.col("user_id").alias("site")).agg(
        part(kind == "click", 12).alias("load_more_controls"),
        part(kind == "view", 14).alias("next_controls"),
        part(kind == "error", 16).alias("numbered_pagination"),
        part(value > 90, 2).alias("load_more_growth"),
        part(value < 5, 3).alias("scroll_growth"),
        (F.count("*") % 7).alias("job_anchor_count"),
        (F.count("*") % 11).alias("page_height_delta"),
    )
    return counted.withColumns({"scrollable_container": site % 3 == 0, "load_more_clicked": site % 5 == 0})


LOAD_SQL = f"""{DOM_SQL}, load AS (SELECT *, matched AND load_more_controls > 0 AND (load_more_growth > 0 OR load_more_clicked) AS usable FROM base)"""
SCROLL_SQL = f"""{DOM_SQL}, scroll AS (SELECT *, matched AND (scroll_growth > 0 OR (scrollable_container
  AND load_more_controls = 0 AND next_controls = 0 AND numbered_pagination = 0 AND page_height_delta > 0)) AS usable FROM base)"""
LOAD_CONF = "CASE WHEN usable THEN 4 + least(load_more_controls, 2) + least(load_more_growth, 4) ELSE 0 END::DOUBLE"
SCROLL_CONF = "CASE WHEN usable THEN 4 + least(scroll_growth, 4) + CASE WHEN scrollable_container THEN 2 ELSE 0 END ELSE 0 END::DOUBLE"
DETECTED = ("site", "matched", "usable", "jobs_found", "confidence")


@query(
    "detect_load_more",
    f"WITH {LOAD_SQL} SELECT site, matched, usable, job_anchor_count AS jobs_found, {LOAD_CONF} AS confidence FROM load",
)
def _(t: Tables) -> DataFrame:
    return sg.detect_load_more(dom_signals(t)).select(*DETECTED)


@query(
    "detect_infinite",
    f"WITH {SCROLL_SQL} SELECT site, matched, usable, job_anchor_count AS jobs_found, {SCROLL_CONF} AS confidence FROM scroll",
)
def _(t: Tables) -> DataFrame:
    return sg.detect_infinite(dom_signals(t)).select(*DETECTED)


@query(
    "detect_interactive",
    rf"""WITH p AS (SELECT page_id, page_id % 6 <> 5 AS available, left(html, (length(html) * (page_id % 10 + 1)) // 10) AS a, html AS b FROM pages),
      c AS (SELECT page_id, available, length(a) AS n0, length(b) AS n1, ({sum_sql("lower(b)", PAGE_TERMS)})::BIGINT AS s,
        greatest(len(list_filter(regexp_extract_all(b, '(?i)href=["'']([^"'']+)["'']', 1), lambda x: regexp_matches(x, '(?i)/th|/an|tion'))), page_id % 4) AS l FROM p),
      m AS (SELECT *, available AND n0 > 0 AND n1 > n0 * 1.3::DOUBLE AND (s >= 3 OR l >= 3) AS matched FROM c)
      SELECT page_id, matched, CASE WHEN matched THEN l ELSE 0 END AS jobs_found,
        CASE WHEN matched THEN least(0.95::DOUBLE, 0.4::DOUBLE + least(0.4::DOUBLE, (n1 - n0)::DOUBLE / greatest(n0, 1) * 0.1::DOUBLE)
          + least(0.3::DOUBLE, s * 0.03::DOUBLE) + least(0.3::DOUBLE, l * 0.02::DOUBLE)) ELSE 0::DOUBLE END AS confidence FROM m""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    head = F.floor(F.length("html") * (n % 10 + 1) / 10).cast("int")
    probes = t.pages.select(
        "page_id",
        (n % 6 != 5).alias("available"),
        F.left("html", head).alias("initial_html"),
        F.col("html").alias("final_html"),
        (n % 4).alias("job_links_count"),
    )
    found = sg.detect_interactive(probes, PAGE_TERMS, ("/th", "/an", "tion"))
    return found.select("page_id", "matched", "jobs_found", "confidence")


@query(
    "dom_signal_deltas",
    """WITH s AS (SELECT user_id AS site, (day(ts) - 1) // 10 AS phase, count(*) AS a, round(max(value) * 10)::BIGINT AS h FROM events GROUP BY ALL),
      w AS (SELECT site, coalesce(max(a) FILTER (phase = 0), 0) AS a0, coalesce(max(a) FILTER (phase = 1), 0) AS a1, coalesce(max(a) FILTER (phase = 2), 0) AS a2,
        coalesce(max(h) FILTER (phase = 0), 0) AS h0, coalesce(max(h) FILTER (phase = 2), 0) AS h2 FROM s GROUP BY site)
      SELECT site, a2 AS job_anchor_count, h2 AS page_height, greatest(0, h2 - h0) AS page_height_delta,
        greatest(0, a1 - a0) AS load_more_growth, greatest(0, a2 - a1) AS scroll_growth FROM w""",
)
def _(t: Tables) -> DataFrame:
    snapshots = t.events.groupBy(
        F.col("user_id").alias("site"), F.floor((F.dayofmonth("ts") - 1) / 10).alias("phase")
    ).agg(F.count("*").alias("job_anchor_count"), F.round(F.max("value") * 10).cast("long").alias("page_height"))
    return sg.dom_signal_deltas(snapshots)


# --- Strategy ---------------------------------------------------------------

CONF_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in sg.SITE_CONFIDENCE) + "]"
CLASSIFY_SQL = f"""{LOAD_SQL},
  scroll AS (SELECT *, matched AND (scroll_growth > 0 OR (scrollable_container AND load_more_controls = 0 AND next_controls = 0
    AND numbered_pagination = 0 AND page_height_delta > 0)) AS usable FROM base),
  det AS (
    SELECT site, 'DOM_LOAD_MORE' AS detector, usable AS viable, job_anchor_count AS jobs_found, {LOAD_CONF} AS confidence, 2 AS prio FROM load
    UNION ALL SELECT site, 'DOM_INFINITE_SCROLL', usable, job_anchor_count, {SCROLL_CONF}, 1 FROM scroll
    UNION ALL SELECT site, 'DYNAMIC_API', numbered_pagination + load_more_controls >= 3 AND site % 4 = 0, next_controls * 10, 0.9::DOUBLE, 5 FROM base
    UNION ALL SELECT site, 'INTERACTIVE_DOM', site % 7 = 0, 3, 0.9::DOUBLE, 3 FROM base),
  best AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY confidence DESC, jobs_found DESC, prio DESC) AS k FROM det WHERE viable),
  chosen AS (SELECT base.site, coalesce(best.detector, 'UNKNOWN') AS type,
    CASE WHEN best.detector IS NULL THEN 0::DOUBLE ELSE ({CONF_SQL})[least(greatest(best.jobs_found, 1), 25)::BIGINT] END AS confidence FROM base LEFT JOIN (SELECT * FROM best WHERE k = 1) best USING (site))"""


def detections(t: Tables) -> DataFrame:
    dom = dom_signals(t)
    nothing = F.lit(None).cast("long").alias("best_score")
    shared = ("site", "detector", "matched", "usable", "jobs_found", "confidence")
    score = F.when(F.col("site") % 4 == 0, F.col("numbered_pagination") + F.col("load_more_controls") + 2).otherwise(0)
    dynamic = dom.select(
        "site", F.lit("DYNAMIC_API").alias("detector"), F.lit(False).alias("matched"), F.lit(False).alias("usable"),
        (F.col("next_controls") * 10).alias("jobs_found"), F.lit(0.9).alias("confidence"), score.alias("best_score"),
    )
    live = dom.select(
        "site", F.lit("INTERACTIVE_DOM").alias("detector"), (F.col("site") % 7 == 0).alias("matched"),
        F.lit(False).alias("usable"), F.lit(3).cast("long").alias("jobs_found"), F.lit(0.9).alias("confidence"), nothing,
    )
    return (
        sg.detect_load_more(dom).select(*shared, nothing)
        .unionByName(sg.detect_infinite(dom).select(*shared, nothing))
        .unionByName(dynamic)
        .unionByName(live)
    )


@query("classify_sites", f"WITH {CLASSIFY_SQL} SELECT site, type, confidence FROM chosen")
def _(t: Tables) -> DataFrame:
    return sg.classify_sites(detections(t))


@query(
    "classify_sites_by_priority",
    f"""WITH {CLASSIFY_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY prio DESC) AS r FROM det WHERE viable)
      SELECT base.site, coalesce(p.detector, 'UNKNOWN') AS type FROM base LEFT JOIN (SELECT * FROM p WHERE r = 1) p USING (site)""",
)
def _(t: Tables) -> DataFrame:
    return sg.classify_sites(detections(t), by="priority").select("site", "type")


@query(
    "validate_verdicts",
    f"""WITH {CLASSIFY_SQL} SELECT site, CASE site % 5 WHEN 0 THEN 'SIMPLE_API' WHEN 1 THEN 'UNKNOWN' ELSE type END AS type,
        CASE site % 5 WHEN 0 THEN least(site / 100, 1)::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE confidence END AS confidence,
        site % 5 < 2 AS from_reply FROM chosen""",
)
def _(t: Tables) -> DataFrame:
    site = F.col("site")
    good = F.concat(F.lit('```json\n{"type": "SIMPLE_API", "confidence": '), (site / 100).cast("string"), F.lit("}\n```"))
    content = (
        F.when(site % 5 == 0, good)
        .when(site % 5 == 1, F.lit('{"reason": "none"}'))
        .when(site % 5 == 2, F.lit('{"type": "SOMETHING", "confidence": 0.5}'))
        .when(site % 5 == 3, F.lit('{"type": "SIMPLE_API", "confidence": "high"}'))
    )
    classified = sg.classify_sites(detections(t))
    replies = t.events.select(F.col("user_id").alias("site")).distinct().where("site % 5 < 4").select("site", content.alias("content"))
    return sg.validate_verdicts(replies, classified)


@query("strategy", f"WITH {CLASSIFY_SQL} SELECT site, CASE WHEN contains(type, 'API') THEN 'api' ELSE 'dom' END AS strategy FROM chosen")
def _(t: Tables) -> DataFrame:
    return sg.classify_sites(detections(t)).select("site", sg.strategy(F.col("type")).alias("strategy"))


# --- Records and runs -------------------------------------------------------

RECORD_SQL = """records AS (SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS location, text AS description,
    CASE WHEN contains(text, '$') THEN '$' END AS salary, CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE []::VARCHAR[] END AS skills,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE NULL END AS experience FROM documents),
  scored AS (SELECT doc_id, (2 + (location IS NOT NULL)::INTEGER + CASE WHEN length(description) > 300 THEN 2 ELSE 0 END
    + (salary IS NOT NULL)::INTEGER + (len(skills) > 0)::INTEGER)::BIGINT AS score FROM records)"""


def records(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        F.col("lang").alias("title"),
        F.when(n % 2 == 0, F.col("source")).alias("location"),
        F.col("text").alias("description"),
        F.when(F.col("text").contains("$"), F.lit("$")).alias("salary"),
        F.when(n % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("skills"),
        F.when(n % 7 == 0, F.lit("")).alias("experience"),
    )


@query("confidence", f"WITH {RECORD_SQL} SELECT doc_id, score FROM scored")
def _(t: Tables) -> DataFrame:
    return records(t).select("doc_id", sg.confidence().alias("score"))


@query("needs_enrichment", f"WITH {RECORD_SQL} SELECT doc_id FROM scored WHERE score < 4")
def _(t: Tables) -> DataFrame:
    return sg.needs_enrichment(records(t)).select("doc_id")


@query(
    "filled_fields",
    f"""WITH {RECORD_SQL} SELECT doc_id, (1 + (location IS NOT NULL)::INTEGER + 1 + (salary IS NOT NULL)::INTEGER + (len(skills) > 0)::INTEGER)::BIGINT AS filled_fields
      FROM records""",
)
def _(t: Tables) -> DataFrame:
    fields = ("title", "location", "description", "salary", "skills", "experience")
    return sg.filled_fields(records(t), fields).select("doc_id", "filled_fields")


RUN_SQL = """runs AS (SELECT o_custkey AS site, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
  o_orderkey % 4 AS jobs_found, o_orderpriority FROM orders)"""


@query(
    "run_summary",
    f"""WITH {RUN_SQL} SELECT o_orderpriority, count(*) AS total_sites, count(*) FILTER (status = 'success' AND jobs_found > 0) AS successful,
      count(*) FILTER (status = 'failed' OR (status = 'success' AND jobs_found = 0)) AS failed, count(*) FILTER (status = 'skipped') AS skipped
      FROM runs GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    runs = t.orders.select(
        "o_orderpriority",
        F.when(status == "F", F.lit("success")).when(status == "O", F.lit("skipped")).otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 4).alias("jobs_found"),
    )
    return sg.run_summary(runs, ["o_orderpriority"])


@query(
    "run_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'skipped' WHEN o_orderkey % 4 > 0 THEN 'success' ELSE 'failed' END AS status FROM orders""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", F.lit(lex.UNKNOWN)).otherwise("SIMPLE_API")
    return t.orders.select("o_orderkey", sg.run_status(F.col("o_orderkey") % 4, kind).alias("status"))


@query("token_totals", "SELECT role AS domain, sum(length(text) // 4)::BIGINT AS total_tokens FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from postlake.operators.payloads import token_usage

    used = token_usage(t.conversations.withColumnRenamed("text", "content")).withColumnRenamed("role", "domain")
    return sg.token_totals(used)


@query(
    "sample_counts",
    f"SELECT {DOMAIN_SQL} AS domain, count(*) AS jobs_count FROM pages GROUP BY ROLLUP (1)",
)
def _(t: Tables) -> DataFrame:
    return sg.sample_counts(t.pages.select(u.get_domain(F.col("url")).alias("domain")))
