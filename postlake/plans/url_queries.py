"""URL, key and candidate queries over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import urls as u
from postlake.operators import candidates as cand
from postlake.operators.html import anchors
from postlake.plans.registry import Tables, query

DOMAIN_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
ORIGIN_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
WORD_SQL = f"regexp_extract({DOMAIN_SQL}, '([a-z]+)[.]example', 1)"
ANCHOR_SQL = r"""
  found AS (
    SELECT page_id, url, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS m
    FROM (SELECT page_id, url,
                 regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>') AS m
          FROM pages)),
  anchors AS (
    SELECT page_id, url, pos,
           regexp_extract(m, '(?is)href=["'']([^"'']+)["'']', 1) AS href,
           regexp_replace(regexp_extract(m, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g') AS label
    FROM found)
"""


def form(n: int) -> Column:
    return F.col("page_id") % n


def word(c: Column) -> Column:
    return F.regexp_extract(u.get_domain(c), r"([a-z]+)[.]example", 1)


@query(
    "normalize_site_url",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url
         WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN 2 THEN url ELSE '' END AS site
       FROM pages""",
)
def _(t: Tables) -> DataFrame:
    raw = (
        F.when(form(4) == 0, F.col("url"))
        .when(form(4) == 1, F.regexp_replace("url", "^https?://", ""))
        .when(form(4) == 2, F.concat(F.lit(" \t"), F.col("url"), F.lit(" \n")))
        .otherwise("  ")
    )
    return t.pages.select("page_id", u.normalize_site_url(raw).alias("site"))


@query("get_domain", f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def _(t: Tables) -> DataFrame:
    shouted = F.concat(F.upper(F.regexp_replace("url", "^https?://", "")))
    raw = F.when(form(2) == 0, F.col("url")).otherwise(shouted)
    return t.pages.select("page_id", u.get_domain(raw).alias("domain"))


@query("get_origin", f"SELECT page_id, {ORIGIN_SQL} AS origin FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", u.get_origin(F.col("url")).alias("origin"))


@query(
    "absolutize_url",
    rf"""WITH {ANCHOR_SQL},
      parts AS (SELECT page_id, pos, substr(href, 2) AS rel, {ORIGIN_SQL} AS origin, {PATH_SQL} AS path,
                       regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query FROM anchors),
      dirs AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM parts)
      SELECT page_id, pos, CASE pos % 6
          WHEN 0 THEN origin || '/' || rel
          WHEN 1 THEN origin || dir || rel
          WHEN 2 THEN origin || regexp_replace(dir, '[^/]+/$', '') || rel
          WHEN 3 THEN origin || path || '?q=' || rel
          WHEN 4 THEN origin || path || query || '#' || rel
          ELSE 'https://other.example/' || rel END AS link
      FROM dirs""",
)
def _(t: Tables) -> DataFrame:
    rel = F.expr("substring(href, 2)")
    shape = F.col("pos") % 6
    href = (
        F.when(shape == 0, F.col("href"))
        .when(shape == 1, rel)
        .when(shape == 2, F.concat(F.lit("./.././"), rel))
        .when(shape == 3, F.concat(F.lit("?q="), rel))
        .when(shape == 4, F.concat(F.lit("#"), rel))
        .otherwise(F.concat(F.lit("https://other.example/"), rel))
    )
    rows = anchors(t.pages, keep=["url"])
    return rows.select("page_id", "pos", u.absolutize_url(F.col("url"), href).alias("link"))


@query(
    "looks_like_api_url",
    "SELECT page_id, regexp_matches(lower(url), 'blog|farm|feed|[?]page') AS is_api FROM pages",
)
def _(t: Tables) -> DataFrame:
    found = u.looks_like_api_url(F.col("url"), ("blog", "farm", "feed", "?page"))
    return t.pages.select("page_id", found.alias("is_api"))


@query(
    "url_facets",
    rf"""WITH base AS (SELECT page_id, {DOMAIN_SQL} AS d, url FROM pages)
      SELECT page_id, 'loc' AS facet, d || '|b c' AS vals FROM base
      UNION ALL SELECT page_id, 'team name', d FROM base
      UNION ALL SELECT page_id, 'ref', 'x' FROM base WHERE contains(url, 'ref=x')
      UNION ALL SELECT page_id, 'utm_source', 'feed' FROM base WHERE contains(url, 'utm_source=feed')""",
)
def _(t: Tables) -> DataFrame:
    d = u.get_domain(F.col("url"))
    old = u.url_query(F.col("url"))
    url = F.concat(
        F.lit("https://h.example/p?loc="), d, F.lit("&loc=b%20c&Offset=3&blank=&flag&team+name="), d,
        F.when(old != "", F.concat(F.lit("&"), old)).otherwise(""), F.lit("#top"),
    )
    return (
        t.pages.select("page_id", F.explode(u.url_facets(url)).alias("facet", "v"))
        .select("page_id", "facet", F.array_join("v", "|").alias("vals"))
    )


@query(
    "workday_job_url",
    rf"""SELECT page_id, 'https://' || regexp_extract({DOMAIN_SQL}, '^([^.]+)', 1)
           || '.wd1.myworkdayjobs.com/en-US/' || regexp_extract({PATH_SQL}, '^/*([^/]+)', 1)
           || '/job/P_R' || page_id AS link FROM pages""",
)
def _(t: Tables) -> DataFrame:
    url = F.col("url")
    path = F.concat(F.lit(" //P_R"), F.col("page_id").cast("string"))
    return t.pages.select(
        "page_id", u.workday_job_url(u.workday_tenant(url), u.workday_site(url), path).alias("link")
    )


def _workday_link() -> Column:
    head = F.concat(F.lit("https://"), word(F.col("url")), F.lit(".wd1.example.com"))
    slug = F.concat(F.lit("Engineer_R"), F.col("page_id").cast("string"), F.lit("-1"))
    return (
        F.when(form(4) == 0, F.concat(head, F.lit("/Careers/job/job/Pune/"), slug))
        .when(form(4) == 1, F.concat(head, F.lit("/en-US/Careers/job/Pune/"), slug))
        .when(form(4) == 2, F.concat(head, F.lit("/Careers/job/Pune/"), slug, F.lit("?x=1#f")))
        .otherwise(F.concat(head, F.lit("/Careers/job/job/Plain")))
    )


@query(
    "normalize_workday_url",
    rf"""SELECT page_id, 'https://' || {WORD_SQL} || '.wd1.example.com' || CASE page_id % 4
         WHEN 0 THEN '/Careers/en-US/job/Engineer_R' || page_id || '-1'
         WHEN 1 THEN '/en-US/Careers/job/Pune/Engineer_R' || page_id || '-1'
         WHEN 2 THEN '/Careers/en-US/job/Pune/Engineer_R' || page_id || '-1'
         ELSE '/Careers/en-US/job/Plain' END AS link FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", u.normalize_workday_url(_workday_link()).alias("link"))


@query(
    "workday_job_id",
    """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'Plain'
         ELSE '_R' || page_id || '-1' END AS job_id FROM pages""",
)
def _(t: Tables) -> DataFrame:
    bare = F.concat(F.regexp_replace(_workday_link(), r"[?].*$", ""), F.lit("/"))
    return t.pages.select("page_id", u.workday_job_id(bare).alias("job_id"))


@query(
    "job_id_from_url",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN (1000000 + page_id)::VARCHAR
         WHEN 1 THEN (2000000 + page_id)::VARCHAR WHEN 2 THEN 'AB-' || page_id ELSE '' END AS job_id
       FROM pages""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    site = u.get_origin(F.col("url"))
    link = (
        F.when(form(4) == 0, F.concat(site, F.lit("/"), (n + 1_000_000).cast("string")))
        .when(form(4) == 1, F.concat(site, F.lit("/"), (n + 2_000_000).cast("string"), F.lit("/view")))
        .when(form(4) == 2, F.concat(site, F.lit("?Req_ID=AB-"), n.cast("string")))
        .otherwise(F.concat(site, F.lit("/about")))
    )
    return t.pages.select("page_id", u.job_id_from_url(link).alias("job_id"))


@query(
    "last_segment",
    "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last_segment FROM pages",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", u.last_segment(F.col("url")).alias("last_segment"))


@query(
    "fallback_id",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'J' || page_id
         ELSE regexp_extract(url, '([^/]*)$', 1) END AS id FROM pages""",
)
def _(t: Tables) -> DataFrame:
    given = F.when(form(3) == 0, F.concat(F.lit("J"), F.col("page_id").cast("string"))).otherwise(" ")
    return t.pages.select("page_id", u.fallback_id(given, F.col("url")).alias("id"))


# --- Candidates -------------------------------------------------------------


@query(
    "resolve_board_slug",
    rf"""WITH b AS (SELECT page_id AS site, url, {WORD_SQL} AS w, {ORIGIN_SQL} AS origin FROM pages)
      SELECT site,
        CASE WHEN site % 7 IN (5, 6) THEN '' ELSE w END AS slug,
        CASE site % 7 WHEN 0 THEN 'direct_greenhouse_url' WHEN 1 THEN 'browser_xhr_query_param'
          WHEN 2 THEN 'company_html_board_url' WHEN 3 THEN 'redirect_final_url'
          WHEN 4 THEN 'fetched_html_query_param' WHEN 5 THEN 'not_found' ELSE 'fetch_failed' END AS source,
        CASE site % 7 WHEN 0 THEN 'https://boards.greenhouse.io/' || w || '/jobs'
          WHEN 1 THEN origin || '/embed?for=' || w
          WHEN 2 THEN 'https://job-boards.greenhouse.io/' || w
          WHEN 3 THEN 'https://boards.greenhouse.io/' || w
          WHEN 4 THEN url ELSE '' END AS board_url
      FROM b""",
)
def _(t: Tables) -> DataFrame:
    n, w = F.col("page_id") % 7, word(F.col("url"))
    base = t.pages.select(F.col("page_id").alias("site"), "url", "html", n.alias("n"), w.alias("w"))
    board = F.concat(F.lit("https://boards.greenhouse.io/"), F.col("w"))
    sites = base.select(
        "site", F.when(F.col("n") == 0, F.concat(board, F.lit("/jobs"))).otherwise(F.col("url")).alias("url")
    )
    asked = F.concat(u.get_origin(F.col("url")), F.lit("/embed?for="), F.col("w"))
    discovered = base.where("n = 1").select(
        "site", F.posexplode(F.array(F.lit("https://x.example/a"), asked, board)).alias("seq", "url")
    )
    link = F.concat(F.lit('<a href="https://job-boards.greenhouse.io/'), F.col("w"), F.lit('/jobs">'))
    pages = base.select("site", F.when(F.col("n") == 2, F.concat("html", link)).otherwise(F.col("html")).alias("html"))
    embed = F.concat(F.col("html"), F.lit('<iframe src="/e?b=1&for='), F.col("w"), F.lit('">'))
    fetched = base.where("n < 6").select(
        "site",
        F.when(F.col("n") == 3, board).otherwise(F.col("url")).alias("final_url"),
        F.when(F.col("n") == 4, embed).otherwise(F.col("html")).alias("html"),
    )
    return cand.resolve_board_slug(sites, discovered, pages, fetched)


@query(
    "workday_candidates",
    rf"""WITH b AS (SELECT page_id, {WORD_SQL} AS w, 'https://' || {WORD_SQL} || '.workday.example' AS o,
                           regexp_extract({PATH_SQL}, '^/*([^/]+)', 1) AS lang FROM pages),
      c AS (
        SELECT page_id, 'https://api.' || w || '.workday.example/feed' AS candidate, 1 AS rank, 0 AS seq, 0 AS sub FROM b
        UNION ALL SELECT page_id, 'https://api.' || w || '.workday.example/feed/jobs', 1, 0, 1 FROM b
        UNION ALL SELECT page_id, 'https://h.example/wday/cxs/' || w || '/x/jobs', 2, 0, 0 FROM b
        UNION ALL SELECT page_id, o || '/wday/cxs/Careers/Careers/jobs', 3, 0, 0 FROM b
        UNION ALL SELECT page_id, o || '/wday/cxs/' || w || '/' || w || '/jobs', 4, 0, 0 FROM b
        UNION ALL SELECT page_id, o || '/wday/cxs/' || lang || '/' || lang || '/jobs', 4, 1, 0 FROM b)
      SELECT page_id AS site, candidate, rank::BIGINT AS rank, seq::BIGINT AS seq, sub::BIGINT AS sub FROM c""",
)
def _(t: Tables) -> DataFrame:
    w = word(F.col("url"))
    base = t.pages.select(F.col("page_id").alias("site"), "html", "url", w.alias("w"))
    host = F.concat(F.col("w"), F.lit(".workday.example"))
    sites = base.select("site", F.concat(host, F.lit("/Careers/all")).alias("url"))
    discovered = base.select(
        "site",
        F.posexplode(
            F.array(F.concat(F.lit("//api."), host, F.lit("/feed/")), F.lit("https://cdn.example/x.js"))
        ).alias("seq", "url"),
    )
    extra = F.concat(
        F.lit('<script>{"company": "'), F.col("w"), F.lit('", "tenant":"'), F.col("w"),
        F.lit('", "tenant" : "'), u.workday_site(F.col("url")),
        F.lit('", api:"https://h.example/wday/cxs/'), F.col("w"), F.lit('/x/jobs"}</script>'),
    )
    pages = base.select("site", F.concat("html", extra).alias("html"))
    return cand.workday_candidates(sites, pages, discovered)


@query(
    "company_tokens",
    rf"""WITH b AS (SELECT page_id, {WORD_SQL} AS w, {DOMAIN_SQL} AS d FROM pages)
      SELECT page_id, 0::BIGINT AS pos, w AS token FROM b
      UNION ALL SELECT page_id, 1::BIGINT, d FROM b""",
)
def _(t: Tables) -> DataFrame:
    w, d = word(F.col("url")), u.get_domain(F.col("url"))
    extra = F.concat(
        F.lit('<script>{"company": " '), w, F.lit('", "Tenant":"'), d, F.lit('", "tenant" : "'), w, F.lit('"}')
    )
    return cand.company_tokens(t.pages.select("page_id", F.concat("html", extra).alias("html")))


@query(
    "json_candidates",
    rf"""WITH {ANCHOR_SQL},
      c AS (
        SELECT page_id, {ORIGIN_SQL} || href AS candidate, 1 AS rank, pos AS seq, 0 AS sub FROM anchors
          WHERE regexp_matches(lower({ORIGIN_SQL} || href), 'ing|tion|blog')
        UNION ALL
        SELECT page_id, {ORIGIN_SQL} || rtrim({PATH_SQL}, '/') || s.v, 2, 0, s.i
          FROM pages, (VALUES ('', 0), ('.json', 1)) AS s(v, i)
          WHERE {PATH_SQL} NOT IN ('', '/') AND regexp_matches(lower({ORIGIN_SQL} || {PATH_SQL}), 'ing|tion|blog')
        UNION ALL
        SELECT page_id, {ORIGIN_SQL} || s.v, 3, 0, s.i
          FROM pages, (VALUES ('/jobs', 0), ('/jobs.json', 1), ('/careers/jobs', 2), ('/careers/jobs.json', 3),
            ('/api/jobs', 4), ('/api/jobs.json', 5), ('/api/careers/jobs', 6)) AS s(v, i)),
      f AS (SELECT page_id, candidate, min({{'rank': rank, 'seq': seq, 'sub': sub}}) AS k FROM c GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k.rank, k.seq, k.sub) AS rn FROM f)
      SELECT page_id AS site, candidate FROM r WHERE rn <= 8""",
)
def _(t: Tables) -> DataFrame:
    sites = t.pages.select(F.col("page_id").alias("site"), "url")
    discovered = anchors(t.pages, keep=["url"]).select(
        F.col("page_id").alias("site"),
        F.col("pos").alias("seq"),
        u.absolutize_url(F.col("url"), F.col("href")).alias("url"),
    )
    return cand.json_candidates(sites, discovered, keywords=("ing", "tion", "blog")).select("site", "candidate")


@query(
    "discovered_urls",
    rf"""WITH {ANCHOR_SQL}
      SELECT {DOMAIN_SQL} AS site, {ORIGIN_SQL} || href AS url FROM anchors
      UNION SELECT {DOMAIN_SQL}, url FROM pages""",
)
def _(t: Tables) -> DataFrame:
    site = u.get_domain(F.col("url")).alias("site")
    links = anchors(t.pages, keep=["url"]).select(
        site, u.absolutize_url(F.col("url"), F.col("href")).alias("url")
    )
    return cand.discovered_urls(t.pages.select(site, "url"), links)
