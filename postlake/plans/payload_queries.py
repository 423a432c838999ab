"""Queries over JSON payloads built from the columns of the given tables.

Each page becomes one captured response: its anchors are the job objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import jsonv as jv
from postlake.functions import urls as u
from postlake.functions.text import explode_rows
from postlake.operators import payloads as pl
from postlake.operators import records as rec
from postlake.operators import signals as sg
from postlake.operators.dedupe import dedupe_listings
from postlake.operators.html import anchor_array
from postlake.plans.registry import Tables, query
from postlake.plans.url_queries import ANCHOR_SQL, DOMAIN_SQL, ORIGIN_SQL, form

TITLE_SQL = "trim(regexp_replace(label, '<[^>]+>', ' ', 'g'))"


def anchor_jobs(*extra: Column) -> Column:
    """Job structs of the page's anchors."""

    def job(a: Column, i: Column) -> Column:
        return F.struct(
            a.inner.alias("title"),
            F.struct(F.concat(F.lit("Site "), (i % 3).cast("string")).alias("name")).alias("location"),
            a.href.alias("absolute_url"),
            (i + 1).alias("id"),
        )

    return F.transform(anchor_array(F.col("html")), job)


def responses(t: Tables, body: Column) -> DataFrame:
    return t.pages.select(
        u.get_domain(F.col("url")).alias("site"),
        F.col("page_id").alias("seq"),
        F.col("url"),
        F.col("url").alias("base_url"),
        body.alias("body"),
    ).withColumn("body_length", F.length("body"))


def wrapped(name: str = "jobs") -> Column:
    return F.to_json(F.struct(anchor_jobs().alias(name), F.col("page_id").alias("total")))


JOBS_SQL = rf"""WITH {ANCHOR_SQL}, j AS (SELECT {DOMAIN_SQL} AS site, page_id AS seq, pos, label AS title,
    'Site ' || (pos % 3) AS place, href, url, {ORIGIN_SQL} || href AS link FROM anchors)"""


@query(
    "board_postings",
    JOBS_SQL + " SELECT site, seq, pos::BIGINT AS pos, title, place AS location, href AS url FROM j",
)
def _(t: Tables) -> DataFrame:
    rows = pl.board_postings(responses(t, wrapped()).drop("url"))
    return rows.select("site", "seq", "pos", "title", "location", "url")


@query(
    "find_job_list",
    JOBS_SQL + " SELECT site, seq, pos::BIGINT AS pos, title FROM j",
)
def _(t: Tables) -> DataFrame:
    jobs = anchor_jobs()
    body = (
        F.when(form(5) == 0, F.to_json(jobs))
        .when(form(5) == 1, wrapped("jobPostings"))
        .when(form(5) == 2, F.to_json(F.struct(F.lit(1).alias("n"), F.array(F.lit(1)).alias("a"), jobs.alias("zeta"), jobs.alias("beta"))))
        .when(
            form(5) == 3,
            F.to_json(F.map_from_arrays(F.transform(jobs, lambda j: F.concat(F.lit("k"), (F.lit(100) - j.id).cast("string"))), jobs)),
        )
        .otherwise(F.to_json(F.struct(F.array().cast("array<int>").alias("jobs"), jobs.alias("careers"))))
    )
    rows = pl.find_job_list(responses(t, body))
    return rows.select("site", "seq", "pos", jv.as_text(jv.field(jv.parse(F.col("raw")), "title")).alias("title"))


@query(
    "normalize_job_entry",
    JOBS_SQL
    + r""" SELECT site, seq, pos::BIGINT AS pos, title, place AS location,
        CASE WHEN pos % 2 = 0 THEN link ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/job/J' || pos END AS url,
        CASE WHEN pos % 2 = 0 THEN '' ELSE 'J' || pos END AS job_id,
        CASE WHEN pos % 2 = 0 THEN 'Ops' END AS department FROM j WHERE length(trim(title)) >= 2""",
)
def _(t: Tables) -> DataFrame:
    def job(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.struct(F.lit(None).cast("string").alias("value"), a.inner.alias("text")).alias("title"),
            F.lit(5).alias("job_title"),
            F.when(even, a.href).alias("link"),
            F.when(~even, F.concat(F.lit("J"), i.cast("string"))).otherwise(" ").alias("reqId"),
            i.alias("id"),
            F.concat(F.lit("Site "), (i % 3).cast("string")).alias("city"),
            F.when(even, F.lit("Ops")).alias("department"),
        )

    body = F.to_json(F.struct(F.transform(anchor_array(F.col("html")), job).alias("results")))
    jobs = pl.normalize_job_entry(pl.find_job_list(responses(t, body)), "base_url")
    return jobs.select("site", "seq", "pos", "title", "location", "url", "job_id", "department")


@query(
    "extract_listing_jobs",
    JOBS_SQL
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY seq, link ORDER BY pos) AS n FROM j WHERE trim(title) <> '')
      SELECT site, seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos, title, place AS location, link AS url,
        seq % 3 = 0 AS has_list_key, seq % 3 <> 2 AS from_list FROM k WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    jobs = anchor_jobs()
    deep = F.to_json(
        F.struct(
            F.lit("x").alias("note"),
            F.struct(F.transform(jobs, lambda j: F.struct(F.lit("{not a node").alias("q"), F.array(F.struct(j.alias("job"))).alias("z"))).alias("zz"), F.lit("[1").alias("aa")).alias("tree"),
        )
    )
    body = F.when(form(3) == 0, wrapped("openings")).when(form(3) == 1, F.to_json(jobs)).otherwise(deep)
    rows = pl.extract_listing_jobs(responses(t, body))
    flat = explode_rows(rows, ["site", "seq", "has_list_key", "from_list"], "jobs", "j")
    return flat.select("site", "seq", "pos", "j.*", "has_list_key", "from_list")


@query(
    "location_text",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_type
        WHEN 2 THEN p_name WHEN 3 THEN p_size::VARCHAR ELSE '' END AS location FROM part""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 5
    body = (
        F.when(n == 0, F.to_json(F.struct(F.lit(" ").alias("name"), F.col("p_size").alias("city"), F.col("p_name").alias("label"))))
        .when(n == 1, F.to_json(F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"))))
        .when(n == 2, F.to_json(F.struct(F.concat(F.lit(" "), F.col("p_name")).alias("v"))))
        .when(n == 3, F.col("p_size").cast("string"))
        .otherwise("{}")
    )
    v = F.when(n == 2, jv.field(jv.parse(body), "v")).otherwise(jv.parse(body))
    return t.part.select("p_partkey", pl.location_text(v).alias("location"))


@query(
    "workday_postings",
    JOBS_SQL
    + r""" SELECT site, seq, pos::BIGINT AS pos, title, place AS location, 'https://' || regexp_extract(site, '^([^.]+)', 1)
        || '.wd1.myworkdayjobs.com/en-US/Careers/job' || href AS url FROM j WHERE trim(title) <> ''""",
)
def _(t: Tables) -> DataFrame:
    def job(a: Column, i: Column) -> Column:
        return F.struct(
            a.inner.alias("title"),
            F.when(a.inner != "", a.href).alias("externalPath"),
            F.concat(F.lit("Site "), (i % 3).cast("string")).alias("locationsText"),
        )

    body = F.to_json(F.struct(F.transform(anchor_array(F.col("html")), job).alias("jobPostings")))
    home = F.concat(F.col("site"), F.lit("/Careers?x=1"))
    rows = pl.workday_postings(responses(t, body).withColumn("site_url", home).drop("url"))
    return rows.select("site", "seq", "pos", "title", "location", "url")


# --- Raw objects ------------------------------------------------------------

def part_object() -> Column:
    return F.struct(
        F.lit(" ").alias("title"),
        F.struct(F.lit(0).alias("value"), F.col("p_name").alias("text")).alias("job_title"),
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("reqId"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("category"),
        F.struct(F.lit("x").alias("y")).alias("salary"),
        F.col("p_type").alias("city"),
        F.col("p_name").alias("zzz_note"),
        F.col("p_size").alias("aaa_size"),
        (F.col("p_size") > 25).alias("big"),
        F.lit("tiny").alias("short"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("tools"),
        F.when(F.col("p_partkey") % 2 == 1, F.concat(F.col("p_name"), F.lit(", ,x"))).alias("tech_stack"),
        F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).alias("qualifications"),
        F.col("p_type").alias("requirements"),
    )


def raw_parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(part_object()).alias("raw"))


@query("first_key", "SELECT p_partkey, p_name AS title, 'R' || p_partkey AS job_id FROM part")
def _(t: Tables) -> DataFrame:
    m = jv.as_map(jv.parse(F.col("raw")))
    return raw_parts(t).select(
        "p_partkey",
        pl.first_key(m, ("title", "job_title", "name")).alias("title"),
        pl.first_key(m, ("externalPath", "id", "reqId")).alias("job_id"),
    )


@query(
    "enrich_from_raw",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Listed' ELSE p_name END AS title, p_type AS location,
        'R' || p_partkey AS job_id, p_brand AS company_name, p_type AS department, '' AS salary,
        CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE p_name || '|x' END AS skills,
        CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS qualifications FROM part""",
)
def _(t: Tables) -> DataFrame:
    listed = F.when(F.col("p_partkey") % 2 == 0, F.lit("Listed")).otherwise("")
    out = pl.enrich_from_raw(raw_parts(t).withColumn("title", listed))
    return out.select(
        "p_partkey", "title", "location", "job_id", "company_name", "department", "salary",
        F.array_join("skills", "|").alias("skills"), F.array_join("qualifications", "|").alias("qualifications"),
    )


@query(
    "raw_skills",
    """SELECT p_partkey, 0::BIGINT AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS skill FROM part
      UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'x' END FROM part""",
)
def _(t: Tables) -> DataFrame:
    rows = raw_parts(t).select("p_partkey", pl.raw_skills(jv.parse(F.col("raw"))).alias("skills"))
    return explode_rows(rows, ["p_partkey"], "skills", "skill")


@query("raw_list", "SELECT p_partkey, p_type AS item FROM part WHERE p_partkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    return raw_parts(t).select("p_partkey", F.explode(pl.raw_list(jv.parse(F.col("raw")))).alias("item"))


@query(
    "raw_sections",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1 AS pos, k AS section_title, v AS content FROM (
        SELECT p_partkey, 3 AS o, 'city' AS k, p_type AS v FROM part WHERE length(p_type) > 5
        UNION ALL SELECT p_partkey, 1, 'category', p_type FROM part WHERE length(p_type) > 5
        UNION ALL SELECT p_partkey, 4, 'zzz_note', p_name FROM part WHERE length(p_name) > 5
        UNION ALL SELECT p_partkey, 5, 'aaa_size', p_size::VARCHAR FROM part
        UNION ALL SELECT p_partkey, 6, 'big', CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END FROM part
        UNION ALL SELECT p_partkey, 7, 'tech_stack', p_name || ', ,x' FROM part WHERE p_partkey % 2 = 1
        UNION ALL SELECT p_partkey, 8, 'requirements', p_type FROM part WHERE length(p_type) > 5)
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o) <= 5""",
)
def _(t: Tables) -> DataFrame:
    return (
        raw_parts(t)
        .select("p_partkey", F.posexplode(pl.raw_sections(F.col("raw"))).alias("pos", "s"))
        .select("p_partkey", "pos", "s.*")
    )


@query(
    "drop_keys",
    "SELECT p_partkey, 'job_title,category,city,zzz_note,aaa_size,big,short,' || CASE WHEN p_partkey % 2 = 0 THEN 'tools,' ELSE 'tech_stack,' END || 'requirements' AS keys FROM part",
)
def _(t: Tables) -> DataFrame:
    kept = F.transform(pl.drop_keys(F.col("raw")), lambda e: e.key)
    return raw_parts(t).select("p_partkey", F.array_join(kept, ",").alias("keys"))


@query(
    "norm_objects",
    """SELECT p_partkey,
        CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '|' || p_type WHEN 2 THEN p_brand || ', ' || p_type ELSE '' END AS location,
        CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN p_size::VARCHAR ELSE '' END AS experience,
        CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN 'EUR ' || p_size ELSE '' END AS salary,
        CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN p_brand ELSE '' END AS education,
        CASE WHEN p_partkey % 4 = 1 THEN 0 ELSE 0 END::BIGINT AS sections FROM part""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 4
    obj = F.struct(
        F.col("p_brand").alias("addressLocality"), F.col("p_type").alias("name"),
        F.struct(F.col("p_size").alias("minValue")).alias("value"), F.lit("EUR").alias("currency"),
        F.lit("").alias("credentialCategory"), F.col("p_brand").alias("description"),
    )
    body = (
        F.when(n == 0, F.to_json(F.array(F.concat(F.lit(" "), F.col("p_name")))))
        .when(n == 1, F.to_json(F.array("p_brand", F.lit(" "), "p_type")))
        .when(n == 2, F.to_json(obj))
        .otherwise("null")
    )
    v = F.when(n == 0, F.try_variant_get(jv.parse(body), "$[0]", "variant")).otherwise(jv.parse(body))
    return t.part.select(
        "p_partkey",
        F.array_join(rec.norm_location(v), "|").alias("location"),
        rec.norm_experience(v).alias("experience"),
        rec.norm_salary(v).alias("salary"),
        rec.norm_education(v).alias("education"),
        F.size(rec.norm_sections(v)).alias("sections"),
    )


@query(
    "norm_sections",
    """SELECT p_partkey, 0::BIGINT AS pos, p_name AS section_title, p_size::VARCHAR AS content FROM part
      UNION ALL SELECT p_partkey, 1, '', p_type FROM part""",
)
def _(t: Tables) -> DataFrame:
    one = F.to_json(F.struct(F.concat(F.col("p_name"), F.lit(" ")).alias("section_title"), F.col("p_size").alias("content")))
    two = F.to_json(F.struct(F.array("p_brand").alias("section_title"), F.col("p_type").alias("content")))
    body = F.concat(F.lit("["), one, F.lit(',"text",'), two, F.lit("]"))
    rows = t.part.select("p_partkey", F.posexplode(rec.norm_sections(jv.parse(body))).alias("pos", "s"))
    return rows.select("p_partkey", "pos", "s.*")


@query(
    "locations_array",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '|' || p_type ELSE '' END AS locations FROM part""",
)
def _(t: Tables) -> DataFrame:
    from postlake.operators.merge import locations_array

    n = F.col("p_partkey") % 3
    body = (
        F.when(n == 0, F.to_json(F.struct(F.col("p_name").alias("v"))))
        .when(n == 1, F.to_json(F.struct(F.array("p_brand", "p_type").alias("v"))))
        .otherwise(F.to_json(F.struct(F.col("p_size").alias("v"))))
    )
    v = jv.field(jv.parse(body), "v")
    return t.part.select("p_partkey", F.array_join(locations_array(v), "|").alias("locations"))


# --- Scores over responses --------------------------------------------------

BODY_SQL = """'{"' || CASE WHEN doc_id % 2 = 0 THEN 'Title' ELSE 'name' END || '":"' || lang || '","'
  || CASE WHEN doc_id % 3 = 0 THEN 'location' ELSE 'place' END || '":"' || source || '","'
  || CASE WHEN doc_id % 5 = 0 THEN 'description' ELSE 'body' END || '":"' || text || '"}'"""
SCORE_SQL = f"""CASE WHEN (SELECT count(*) FROM (VALUES ('the'), ('eau'), ('tion'), ('sch'), ('license')) w(w) WHERE contains(b, w)) >= 3 THEN 3 ELSE 0 END
  + CASE WHEN contains(b, 'description') THEN 3 ELSE 0 END + CASE WHEN contains(b, 'title') THEN 2 ELSE 0 END
  + CASE WHEN contains(b, 'location') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(b, 'reti|ouch') THEN 2 ELSE 0 END
  + CASE WHEN n < 500 THEN -3 ELSE 0 END"""
SCORED_SQL = f"""WITH r AS (SELECT doc_id, source, lower({BODY_SQL}) AS b, length({BODY_SQL}) AS n FROM documents),
  s AS (SELECT doc_id, source, n, ({SCORE_SQL})::BIGINT AS score FROM r)"""


def scored_documents(t: Tables) -> DataFrame:
    def name(n: int, yes: str, no: str) -> Column:
        return F.when(F.col("doc_id") % n == 0, F.lit(yes)).otherwise(no)

    q = F.lit('":"')
    body = F.concat(
        F.lit('{"'), name(2, "Title", "name"), q, "lang", F.lit('","'), name(3, "location", "place"), q, "source",
        F.lit('","'), name(5, "description", "body"), q, "text", F.lit('"}'),
    )
    return t.documents.select(
        F.col("source").alias("site"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example/api/"), F.col("doc_id").cast("string")).alias("url"),
        body.alias("body"),
    ).withColumn("body_length", F.length("body"))


TERMS = {"terms": ("the", "eau", "tion", "sch", "license"), "paging": ("reti", "ouch")}


@query("score_responses", SCORED_SQL + " SELECT doc_id AS seq, score FROM s")
def _(t: Tables) -> DataFrame:
    return sg.score_responses(scored_documents(t), **TERMS).select("seq", "score")


@query(
    "detect_dynamic",
    SCORED_SQL
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s)
      SELECT source AS site, 'https://' || source || '.example/api/' || doc_id AS url, score AS best_score, score >= 5 AS matched,
        CASE WHEN score >= 5 THEN least(0.95::DOUBLE, 0.5::DOUBLE + score * 0.05::DOUBLE) ELSE 0::DOUBLE END AS confidence,
        'POST' AS method, '{"q":"' || source || '"}' AS payload FROM b WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    sites = t.documents.select(F.col("source").alias("site")).distinct()
    base = F.concat(F.lit("https://"), "site", F.lit(".example/"))
    requests = sites.select(
        "site",
        F.posexplode(
            F.array(
                F.struct(F.concat(base, F.lit("js/")).alias("url"), F.lit("GET").alias("method"), F.lit("").alias("post_data")),
                F.struct(
                    F.concat(base, F.lit("api/")).alias("url"), F.lit("POST").alias("method"),
                    F.concat(F.lit('{"q":"'), "site", F.lit('"}')).alias("post_data"),
                ),
                F.struct(base.alias("url"), F.lit("PUT").alias("method"), F.lit("x").alias("post_data")),
            )
        ).alias("seq", "r"),
    ).select("site", "seq", "r.*", F.create_map(F.lit("accept"), F.lit("json")).alias("headers"))
    found = sg.detect_dynamic(scored_documents(t), requests, **TERMS)
    return found.select("site", "url", "best_score", "matched", "confidence", "method", "payload")


@query(
    "request_template",
    rf"""SELECT page_id AS site, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE WHEN page_id % 2 = 0 THEN 'a=1' END AS payload FROM pages""",
)
def _(t: Tables) -> DataFrame:
    best = t.pages.select(F.col("page_id").alias("site"), "url")
    requests = t.pages.where("page_id % 2 = 0").select(
        F.col("page_id").alias("site"), F.lit(0).alias("seq"),
        F.when(form(4) == 0, u.get_origin(F.col("url"))).otherwise(F.concat("url", F.lit("&more"))).alias("url"),
        F.lit("POST").alias("method"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit("a=1").alias("post_data"),
    )
    return pl.request_template(best, requests).select("site", "method", "payload")


@query(
    "estimate_jobs",
    JOBS_SQL
    + """, n AS (SELECT page_id AS seq, count(j.seq) AS n FROM pages LEFT JOIN j ON seq = page_id GROUP BY 1)
      SELECT seq, CASE WHEN seq % 5 = 3 THEN 7 ELSE n END::BIGINT AS jobs FROM n""",
)
def _(t: Tables) -> DataFrame:
    jobs = anchor_jobs()
    body = (
        F.when(form(5) == 0, F.to_json(jobs))
        .when(form(5) == 1, wrapped("items"))
        .when(form(5) == 2, F.to_json(F.struct(F.lit("9").alias("total"), jobs.alias("x"))))
        .when(form(5) == 3, F.to_json(F.struct(F.lit(1.5).alias("total"), F.lit(7).alias("count"), jobs.alias("x"))))
        .otherwise(F.to_json(F.map_from_arrays(F.transform(jobs, lambda j: j.id.cast("string")), jobs)))
    )
    return responses(t, body).select("seq", sg.estimate_jobs(F.col("body")).alias("jobs"))


def endpoints(t: Tables) -> DataFrame:
    jobs = anchor_jobs()
    single = F.to_json(F.struct(F.slice(jobs, 1, 1).alias("jobs")))
    noise = F.to_json(F.struct(jobs.alias("jobs"), F.lit("submenu").alias("kind")))
    body = (
        F.when(form(8) == 0, wrapped())
        .when(form(8) == 1, F.lit("{broken"))
        .when(form(8) == 2, F.lit("[]"))
        .when(form(8) == 3, single)
        .when(form(8) == 4, noise)
        .when(form(8) == 5, F.to_json(F.struct(F.col("page_id").alias("n"))))
        .when(form(8) == 6, F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("title"))).alias("results"))))
        .otherwise(wrapped())
    )
    return (
        responses(t, body)
        .withColumn("rank", F.col("seq"))
        .withColumn("status", F.when(F.col("seq") % 16 == 7, 404).otherwise(200))
        .withColumn("content_type", F.when(F.col("seq") % 16 == 15, F.lit("text/html")).otherwise("application/JSON; x"))
    )


ENDPOINT_SQL = (
    JOBS_SQL
    + r""", n AS (SELECT p.page_id AS seq, any_value(p.url) AS url, count(DISTINCT link) FILTER (trim(title) <> '') AS n,
        coalesce(bool_or(regexp_matches(lower(to_json(title || href)), 'offset|page|cursor|limit')), false) AS paged
        FROM pages p LEFT JOIN j ON seq = page_id GROUP BY 1),
      e AS (SELECT seq, url, n, paged, CASE seq % 8 WHEN 0 THEN CASE WHEN n = 1 THEN 'single_job_endpoint' WHEN n = 0 THEN 'no_job_like_fields' ELSE 'accepted' END WHEN 1 THEN 'json_parse_failed'
        WHEN 2 THEN 'empty_payload' WHEN 3 THEN CASE WHEN n = 0 THEN 'no_job_like_fields' ELSE 'single_job_endpoint' END
        WHEN 4 THEN CASE WHEN n = 1 THEN 'single_job_endpoint' ELSE 'ui_navigation_payload' END WHEN 5 THEN 'missing_job_structure' WHEN 6 THEN 'no_job_like_fields'
        ELSE CASE WHEN seq % 16 = 7 THEN 'http_error' ELSE 'not_json' END END AS reason FROM n),
      v AS (SELECT *, CASE WHEN reason = 'accepted' THEN 3 + CASE WHEN n > 5 THEN 2 ELSE 0 END + CASE WHEN paged THEN 1 ELSE 0 END ELSE 0 END AS score FROM e)"""
)


@query("validate_endpoints", ENDPOINT_SQL + " SELECT seq, reason, score::BIGINT AS score FROM v")
def _(t: Tables) -> DataFrame:
    return sg.validate_endpoints(endpoints(t)).select("seq", "reason", "score")


@query(
    "best_endpoint",
    ENDPOINT_SQL
    + rf""", b AS (SELECT {DOMAIN_SQL} AS site, url, n, score, row_number() OVER (PARTITION BY {DOMAIN_SQL} ORDER BY score DESC, seq) AS k
        FROM v WHERE reason = 'accepted')
      SELECT site, url AS api_url, n AS jobs_found, score::DOUBLE AS confidence FROM b WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    best = sg.best_endpoint(sg.validate_endpoints(endpoints(t)))
    return best.select("site", "api_url", "jobs_found", "confidence")


@query(
    "detect_platform",
    JOBS_SQL
    + """, c AS (SELECT site, seq, url, count(*) AS n FROM j GROUP BY ALL),
      b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS k FROM c)
      SELECT site, url AS api_url, n AS jobs_found, true AS matched FROM b WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = responses(t, wrapped()).withColumnsRenamed({"url": "endpoint"}).withColumn("rank", F.col("seq"))
    found = sg.detect_platform(pl.board_postings(rows), "GREENHOUSE_API")
    return found.select("site", "api_url", "jobs_found", "matched")


@query(
    "has_paging",
    "SELECT page_id AS seq, page_id % 3 = 0 AS by_key, page_id % 3 <> 2 AS by_text FROM pages",
)
def _(t: Tables) -> DataFrame:
    body = (
        F.when(form(3) == 0, F.to_json(F.struct(F.lit(1).alias("totalResults"), F.lit("x").alias("totalPages"))))
        .when(form(3) == 1, F.to_json(F.struct(F.struct(F.lit(1).alias("hasMore"), F.lit(2).alias("Cursor")).alias("meta"))))
        .otherwise("[1, 2]")
    )
    return responses(t, body).select(
        "seq", sg.has_paging(F.col("body")).alias("by_key"), sg.mentions_paging(F.col("body")).alias("by_text")
    )


@query(
    "dedupe_listings",
    JOBS_SQL
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY site, lower(CASE WHEN pos % 4 = 0 THEN title || '|' || place ELSE link END)
        ORDER BY seq, pos) AS n FROM j)
      SELECT site, seq, pos::BIGINT AS pos, title FROM k WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = pl.board_postings(responses(t, wrapped()).drop("url"))
    link = F.when(F.col("pos") % 4 == 0, F.lit("")).otherwise(u.absolutize_url(F.col("base_url"), F.col("url")))
    out = dedupe_listings(rows.withColumn("url", link), ["seq", "pos"], ["site"], lower=True)
    return out.select("site", "seq", "pos", "title")
