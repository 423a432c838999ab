"""The two whole runs over ``events`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.functions import urls as u
from postlake.operators import flows
from postlake.operators import signals as sg
from postlake.plans.page_queries import LANG_SQL, with_posting
from postlake.plans.registry import Tables, query
from postlake.plans.signal_queries import CLASSIFY_SQL, CONF_SQL, detections, dom_signals
from postlake.plans.url_queries import DOMAIN_SQL

# Sites of a job board show no other evidence; all eight kinds of detector are the best somewhere.
ASIDE = "site % 13 <> 0 AND site % 17 <> 0"


def _all_detections(t: Tables) -> DataFrame:
    site, n = F.col("user_id").alias("site"), F.col("event_id")
    board = lambda by: t.events.where(f"event_type = 'purchase' AND user_id % {by} = 0").select(
        site, F.lit("https://board").alias("endpoint"), F.lit(0).alias("rank")
    )
    tried = t.events.where("event_type = 'signup' AND user_id % 11 = 0").select(
        site, F.concat(F.lit("https://api/"), n.cast("string")).alias("url"), (n % 9).alias("score"), (n % 5).alias("jobs_found"),
        n.alias("rank"), (n % 4 == 0).alias("accepted"),
    )
    return flows.detection_table(
        detections(t).where(ASIDE),
        sg.detect_paged(dom_signals(t)).where(ASIDE),
        sg.best_endpoint(tried).where(ASIDE),
        sg.detect_platform(board(13), "GREENHOUSE_API"),
        sg.detect_platform(board(17), "WORKDAY_API"),
    )


def _scraped(t: Tables) -> flows.SiteRun:
    user, n = F.col("user_id"), F.col("event_id")
    text = user.cast("string")
    users = t.events.select("user_id").distinct()
    sites = users.where("user_id % 3 <> 0").select(
        user.alias("id"), F.concat(F.lit("https://s"), text).alias("domain"), F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence")
    )
    ended = F.when(user % 4 == 0, F.concat(F.lit("https://f"), text)).otherwise(F.concat(F.lit("https://s"), text))
    runs = users.select(user.alias("site"), F.concat(F.lit("https://s"), text).alias("url"), ended.alias("final_url"), user.alias("seq"))
    path = F.concat(F.lit("/j/"), (n % 20).cast("string"))
    kinds = F.array(*[F.lit(k) for k in lex.SITE_TYPES])
    listings = t.events.select(
        user.alias("site"), F.get(kinds, (n % 8).cast("int")).alias("detector"), n.alias("pos"),
        F.when(n % 6 == 0, F.lit(" ")).otherwise(F.concat("event_type", (n % 4).cast("string"))).alias("title"),
        F.lit(" x ").alias("location"), path.alias("url"),
    )
    raw = F.concat(F.lit('{"id":'), n.cast("string"), F.lit("}"))
    postings = t.events.select(user.alias("site"), path.alias("url"), n.alias("pos"), raw.alias("raw"))
    jobs = (
        t.events.where("user_id % 3 <> 0")
        .groupBy(user.alias("site_id"), path.alias("url"))
        .agg(F.min("event_id").alias("n"))
        .where("n % 5 = 0")
        .select((F.col("n") + 1).alias("id"), "site_id", F.lit("old").alias("title"), F.lit("x").alias("location"), "url", F.lit("{}").alias("raw_json"))
    )
    replies = users.where("user_id % 19 = 0").select(user.alias("site"), F.lit('{"type": "DOM_BROWSER", "confidence": 0.5}').alias("content"))
    return flows.scrape_sites(sites, jobs, runs, _all_detections(t), listings, postings, replies)


def _number(top: str, key: str, order: str) -> str:
    """New ids as `assign_ids` gives them."""
    return f"""(SELECT max(id) FROM {top}) + (row_number() OVER (PARTITION BY left(md5({key}), 3) ORDER BY {order}) - 1) * 4096
      + ('0x' || left(md5({key}), 3))::BIGINT + 1"""


RUN_SQL = rf"""{CLASSIFY_SQL},
  boards AS (SELECT user_id AS site, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
  tried AS (SELECT user_id AS site, event_id % 5 AS jobs_found, event_id % 9 AS score FROM events
    WHERE event_type = 'signup' AND user_id % 11 = 0 AND event_id % 4 = 0
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 9 DESC, event_id) = 1),
  every_det AS (SELECT site, detector, viable, jobs_found, confidence, prio FROM det WHERE {ASIDE}
    UNION ALL SELECT site, 'DOM_BROWSER', matched AND (next_controls > 0 OR numbered_pagination > 0), job_anchor_count,
      (2 + least(next_controls, 2) + least(numbered_pagination, 2))::DOUBLE, 0 FROM base WHERE {ASIDE}
    UNION ALL SELECT site, 'SIMPLE_API', true, jobs_found, score::DOUBLE, 4 FROM tried WHERE {ASIDE}
    UNION ALL SELECT site, 'GREENHOUSE_API', true, n, 0::DOUBLE, 6 FROM boards WHERE site % 13 = 0
    UNION ALL SELECT site, 'WORKDAY_API', true, n, 0::DOUBLE, 7 FROM boards WHERE site % 17 = 0),
  top AS (SELECT * FROM every_det WHERE viable QUALIFY row_number() OVER (PARTITION BY site ORDER BY confidence DESC, jobs_found DESC, prio DESC) = 1),
  verdicts AS (SELECT base.site, CASE WHEN base.site % 19 = 0 THEN 'DOM_BROWSER' ELSE coalesce(top.detector, 'UNKNOWN') END AS type,
    CASE WHEN base.site % 19 = 0 THEN 0.5::DOUBLE WHEN top.detector IS NULL THEN 0::DOUBLE
      ELSE ({CONF_SQL})[least(greatest(top.jobs_found, 1), 25)::BIGINT] END AS confidence FROM base LEFT JOIN top USING (site)),
  old_sites AS (SELECT site AS id FROM base WHERE site % 3 <> 0),
  ended AS (SELECT site, type, confidence, CASE WHEN site % 4 = 0 THEN 'https://f' ELSE 'https://s' END || site AS domain FROM verdicts),
  placed AS (SELECT *, site AS site_id FROM ended WHERE site % 3 <> 0
    UNION ALL SELECT *, {_number("old_sites", "domain", "domain")} FROM ended WHERE site % 3 = 0),
  listed AS (SELECT e.user_id AS site, event_id AS pos, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type || event_id % 4 END AS title,
      '/j/' || event_id % 20 AS url, p.site_id, p.type FROM events e JOIN placed p ON p.site = e.user_id
      AND p.type = ([{", ".join(f"'{k}'" for k in lex.SITE_TYPES)}])[event_id % 8 + 1])"""


@query(
    "scrape_sites_results",
    rf"""WITH {RUN_SQL}, n AS (SELECT site, count(*) AS jobs_found FROM listed GROUP BY 1)
      SELECT site, site_id, type, confidence, coalesce(jobs_found, 0) AS jobs_found,
        CASE WHEN type = 'UNKNOWN' THEN 'skipped' WHEN coalesce(jobs_found, 0) > 0 THEN 'success' ELSE 'failed' END AS status,
        CASE WHEN contains(type, 'API') THEN 'api' ELSE 'dom' END AS strategy, domain FROM placed LEFT JOIN n USING (site)""",
)
def _(t: Tables) -> DataFrame:
    run = _scraped(t)
    return run.results.join(run.sites.select(F.col("id").alias("site_id"), "domain"), "site_id", "left")


@query(
    "scrape_sites_jobs",
    rf"""WITH {RUN_SQL},
      jobs AS (SELECT min(event_id) + 1 AS id, user_id AS site_id, '/j/' || event_id % 20 AS url FROM events WHERE user_id % 3 <> 0
        GROUP BY 2, 3 HAVING min(event_id) % 5 = 0),
      raws AS (SELECT user_id AS site, '/j/' || event_id % 20 AS url, min(event_id) AS n FROM events GROUP BY ALL),
      fresh AS (SELECT site_id, listed.url, title, 'x' AS location, CASE WHEN contains(type, 'API') THEN '{{"id":' || raws.n || '}}'
          ELSE '{{"title":"' || title || '","location":" x ","url":"' || listed.url || '"}}' END AS raw_json
        FROM listed JOIN raws ON raws.site = listed.site AND raws.url = listed.url WHERE title <> ''
        QUALIFY row_number() OVER (PARTITION BY site_id, listed.url ORDER BY pos DESC) = 1),
      m AS (SELECT j.id, coalesce(j.site_id, f.site_id) AS site_id, coalesce(j.url, f.url) AS url, coalesce(f.title, 'old') AS title,
        'x' AS location, coalesce(f.raw_json, '{{}}') AS raw_json FROM jobs j FULL JOIN fresh f ON j.site_id = f.site_id AND j.url = f.url)
      SELECT id, site_id, title, location, url, raw_json FROM m WHERE id IS NOT NULL
      UNION ALL SELECT {_number("jobs", "site_id || chr(31) || url", "site_id, url")}, site_id, title, location, url, raw_json FROM m WHERE id IS NULL""",
)
def _(t: Tables) -> DataFrame:
    return _scraped(t).jobs.select("id", "site_id", "title", "location", "url", "raw_json")


def _as_api(domain: Column) -> Column:
    return F.when(domain.isin("en", "de"), F.lit("SIMPLE_API")).otherwise("DOM_BROWSER")


@query(
    "detail_jobs",
    rf"""WITH saved AS (SELECT {LANG_SQL} AS domain, page_id % 3 AS ts, page_id AS pos, url, {DOMAIN_SQL} AS host FROM pages),
      newest AS (SELECT * FROM saved QUALIFY ts = max(ts) OVER (PARTITION BY domain)),
      firsts AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) <= 5),
      kinds AS (SELECT *, domain IN ('en', 'de') AS api, pos % 7 <> 0 AS found FROM firsts)
      SELECT domain, pos, CASE WHEN api THEN 'api' ELSE 'dom' END AS strategy,
        CASE WHEN api THEN 'SIMPLE_API' ELSE 'DOM_BROWSER' END AS site_type,
        CASE WHEN api THEN 'Listed ' || pos WHEN found THEN 'Role ' || pos ELSE '' END AS title,
        CASE WHEN api THEN 'Acme' WHEN found THEN host ELSE '' END AS company_name, url AS job_link,
        CASE WHEN api THEN 'Pune' WHEN found THEN domain || ', IN' ELSE '' END AS locations,
        CASE WHEN api THEN 'R' || pos ELSE '' END AS job_id,
        CASE WHEN api THEN 'R' || pos ELSE regexp_extract(url, '([^/]*)$', 1) END AS id,
        CASE WHEN NOT api AND found THEN 'USD ' || (pos * 1000 + 1) || '-' || (pos * 1000 + 500) ELSE '' END AS salary,
        CASE WHEN NOT api AND found THEN '5 years' ELSE '' END AS experience,
        CASE WHEN api THEN 'SQL|Go' WHEN found THEN 'Python|' || regexp_extract(host, '^([^.]+)', 1) ELSE '' END AS required_skill_set FROM kinds""",
)
def _(t: Tables) -> DataFrame:
    """Runs of three times per language; the newest one's first five jobs, two languages served by an API."""
    n, lang = F.col("page_id"), u.workday_site(F.col("url"))
    raw = F.to_json(
        F.struct(
            F.concat(F.lit("R"), n.cast("string")).alias("reqId"), F.lit("Acme").alias("company"),
            F.array(F.lit("SQL"), F.lit("Go")).alias("skills"), F.lit("Elsewhere").alias("location"),
        )
    )
    saved = t.pages.select(
        lang.alias("domain"), _as_api(lang).alias("site_type"), (n % 3).cast("string").alias("timestamp"), n.alias("pos"),
        F.concat(F.lit("Listed "), n.cast("string")).alias("title"), F.lit("Pune").alias("location"), "url", raw.alias("raw"),
    )
    pages = with_posting(t.pages).where("page_id % 7 <> 0").select("url", "html")
    out = flows.detail_jobs(saved, pages)
    return out.select(
        "domain", "pos", "strategy", "site_type", "title", "company_name", "job_link", F.array_join("locations", "|").alias("locations"),
        "job_id", "id", "salary", "experience", F.array_join("required_skill_set", "|").alias("required_skill_set"),
    )
