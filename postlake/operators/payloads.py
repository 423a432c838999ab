"""Jobs and fields inside captured JSON payloads, model replies and prompts.

VARIANT gives typed values; where the order of keys matters the JSON text itself is read,
because a VARIANT sorts its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import jsonv as jv
from postlake.functions import lexicons as lex
from postlake.functions.text import filled, first_by, join_filled, let, lit_array, or_empty, strip
from postlake.functions.urls import (
    absolutize_url,
    workday_job_url,
    workday_site,
    workday_tenant,
)
from postlake.operators import records
from postlake.operators.fields import split_list

LIST_CAP = 15


# --- D20 - D24: one raw object ----------------------------------------------


def first_key(m: Column, keys: Sequence[str], nested: Sequence[str] = ("value", "text")) -> Column:
    """First key of a ``map<string,variant>`` holding a string that is not blank.

    The string may also sit in a small object, under one of the ``nested`` keys.
    """

    def pick(x: Column) -> Column:
        inner = jv.string_value(jv.first_truthy(jv.as_map(x), nested))
        return F.coalesce(jv.string_value(x), inner)

    return jv.first_of(m, keys, pick)


def _texts(v: Column, cap: int = LIST_CAP) -> Column:
    """Stripped texts of an array value."""
    items = F.transform(jv.as_list(v), lambda x: filled(jv.as_text(x)))
    return F.slice(F.filter(items, lambda s: s.isNotNull()), 1, cap)


def raw_skills(v: Column) -> Column:
    def listed(value: Column) -> Column:
        return let(_texts(value), lambda texts: F.when(F.size(texts) > 0, texts))

    def split(value: Column, sep: str) -> Column:
        return let(jv.string_value(value), lambda s: F.slice(split_list(s, sep), 1, LIST_CAP))

    def plain(value: Column) -> Column:
        return F.coalesce(listed(value), split(value, ","))

    def bullet(value: Column) -> Column:
        return F.coalesce(split(value, ";"), _texts(value))

    def picked(bound: Column) -> Column:
        plains = [let(jv.field(bound, key), plain) for key in lex.RAW_SKILL_KEYS]
        bullets = let(
            jv.field(bound, "bulletFields"),
            lambda b: F.coalesce(*[let(jv.field(b, key), bullet) for key in lex.RAW_BULLET_KEYS]),
        )
        return F.coalesce(*plains, bullets, lit_array([]))

    return let(v, picked)


def raw_list(v: Column, keys: Sequence[str] = lex.RAW_QUALIFICATION_KEYS) -> Column:
    """First list (even an empty one) or single string under the keys."""

    def pick(value: Column) -> Column:
        single = let(jv.string_value(value), lambda s: F.when(s.isNotNull(), F.array(s)))
        return F.coalesce(_texts(value), single)

    return let(v, lambda bound: F.coalesce(*[let(jv.field(bound, key), pick) for key in keys], lit_array([])))


def drop_keys(raw: Column, keys: Sequence[str] = lex.RAW_KNOWN_KEYS) -> Column:
    """Entries of a JSON object, in document order, without the known keys."""
    return F.filter(
        F.coalesce(jv.ordered_entries(raw), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: ~e.key.isin(*keys),
    )


def raw_sections(raw: Column, known: Sequence[str] = lex.RAW_KNOWN_KEYS, cap: int = 5) -> Column:
    """Left-over short attributes as ``array<struct<section_title, content>>``."""

    def section(e: Column, value: Column) -> Column:
        return F.struct(
            e.key.alias("section_title"),
            F.when(jv.is_string(value), jv.as_text(value))
            .when(
                jv.is_scalar(value),
                F.when(e.value == "true", F.lit("True"))
                .when(e.value == "false", F.lit("False"))
                .otherwise(e.value),
            )
            .alias("content"),
            jv.is_string(value).alias("is_text"),
        )

    def typed(values: Column) -> Column:
        return F.transform(drop_keys(raw, known), lambda e: let(values[e.key], lambda value: section(e, value)))

    kept = F.filter(
        let(jv.as_map(jv.parse(raw)), typed),
        lambda s: s.content.isNotNull()
        & (~s.is_text | ((F.length(s.content) > 5) & (F.length(s.content) < 500))),
    )
    return F.transform(
        F.slice(kept, 1, cap),
        lambda s: F.struct(s.section_title.alias("section_title"), s.content.alias("content")),
    )


def enrich_from_raw(listings: DataFrame, raw: str = "raw") -> DataFrame:
    """Detail columns from the raw API object; listing values win for the core fields."""
    v, m = F.col("_v"), F.col("_m")

    def key(name: str) -> Column:
        return or_empty(first_key(m, lex.RAW_KEYS[name]))

    def keep_or(name: str) -> Column:
        if name in listings.columns:
            return F.coalesce(filled(F.col(name)), first_key(m, lex.RAW_KEYS[name]))
        return first_key(m, lex.RAW_KEYS[name])

    place_parts = join_filled(", ", *[first_key(m, (k,)) for k in lex.RAW_PLACE_PARTS])
    out = {
        "title": or_empty(keep_or("title")),
        "location": or_empty(F.coalesce(keep_or("location"), place_parts)),
        "job_id": or_empty(keep_or("job_id")),
        "company_name": or_empty(keep_or("company_name")),
    }
    for name in (
        "department", "employment_type", "posted_on", "salary", "remote_type", "description",
        "experience", "education",
    ):
        out[name] = key(name)
    out["skills"] = raw_skills(v)
    out["qualifications"] = raw_list(v)
    out["additional_sections"] = raw_sections(F.col(raw))
    return (
        listings.withColumn("_v", jv.parse(F.col(raw)))
        .withColumn("_m", jv.as_map(v))
        .withColumns(out)
        .drop("_v", "_m")
    )


# --- D25 - D30: job objects in a payload ------------------------------------


def _array_field_texts(raw: Column, key: str) -> Column:
    """Elements, as text, of an array field of a JSON object."""
    return jv.raw_items(F.get_json_object(raw, f'$["{key}"]'))


def _as_texts(values: Column) -> Column:
    return F.transform(values, lambda x: jv.text_of(x))


def job_object_texts(raw: Column) -> Column:
    """JSON texts of the job objects of one payload, by the first branch that applies."""
    v = jv.parse(raw)

    def job_like(value: Column) -> Column:
        head = F.try_element_at(jv.as_list(value), F.lit(1))
        return jv.is_object(head) & (
            jv.field(head, "title").isNotNull() | jv.field(head, "location").isNotNull()
        )

    def from_object(values: Column) -> Column:
        ordered = F.transform(F.json_object_keys(raw), lambda k: values[k])
        listed = [
            F.when(F.size(jv.as_list(values[k])) > 0, _as_texts(jv.as_list(values[k])))
            for k in lex.JOB_LIST_KEYS
        ]
        first_like = F.try_element_at(F.filter(ordered, job_like), F.lit(1))
        nested = F.flatten(
            F.transform(
                ordered,
                lambda x: F.when(jv.is_object(x), F.array(x)).otherwise(
                    F.coalesce(F.filter(jv.as_list(x), jv.is_object), F.array().cast("array<variant>"))
                ),
            )
        )
        return F.coalesce(*listed, _as_texts(jv.as_list(first_like)), _as_texts(nested))

    return F.coalesce(
        F.when(jv.is_array(v), _as_texts(jv.as_list(v))),
        F.when(jv.is_object(v), let(jv.as_map(v), from_object)),
        lit_array([]),
    )


def find_job_list(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per job object of every payload, with its position."""
    kept = [c for c in responses.columns if c != body]
    return responses.select(
        *kept, F.posexplode(job_object_texts(F.col(body))).alias("pos", "raw")
    )


def normalize_job_entry(jobs: DataFrame, base: str, raw: str = "raw") -> DataFrame:
    """Title, location, URL, id and five extras of a job object; rows without a title go."""
    m = F.col("_m")

    def pick(keys: Sequence[str]) -> Column:
        return first_key(m, keys, ("value", "text", "label"))

    found = {
        "title": pick(lex.ENTRY_TITLE_KEYS),
        "location": or_empty(
            F.coalesce(
                pick(lex.ENTRY_PLACE_KEYS), join_filled(", ", *[pick(k) for k in lex.ENTRY_PLACE_PARTS])
            )
        ),
        "_link": pick(lex.ENTRY_URL_KEYS),
        "job_id": or_empty(pick(lex.ENTRY_ID_KEYS)),
    }
    for extra in lex.ENTRY_EXTRAS:
        value = F.try_element_at(m, F.lit(extra))
        found[extra] = F.when(jv.is_string(value), F.nullif(jv.as_text(value), F.lit("")))
    by_id = F.when(F.col("job_id") != "", F.concat(F.lit("/job/"), "job_id"))
    link = F.coalesce("_link", by_id)
    return (
        jobs.withColumn("_m", jv.as_map(jv.parse(F.col(raw))))
        .where(F.col("_m").isNotNull())
        .withColumns(found)
        .where(F.length("title") >= 2)
        .withColumn("url", F.when(link.isNull(), F.col(base)).otherwise(absolutize_url(F.col(base), link)))
        .drop("_m", "_link")
    )


def location_text(v: Column) -> Column:
    """Text of a location value: named part of an object, joined list, or scalar."""
    listed = F.filter(F.transform(jv.as_list(v), lambda x: filled(jv.as_text(x))), lambda s: s.isNotNull())
    named = or_empty(jv.first_of(jv.as_map(v), lex.PLACE_NAME_KEYS, jv.string_value))
    return (
        F.when(jv.is_object(v), named)
        .when(jv.is_array(v), F.array_join(listed, ", "))
        .when(jv.truthy(v), strip(jv.as_text(v)))
        .otherwise("")
    )


_JOB = "array<struct<title:string,location:string,url:string>>"


def _simple_job(v: Column, base: Column) -> Column:
    """Job struct of an object with a title string and a location, else null."""

    def of(x: Column) -> Column:
        url = strip(or_empty(jv.as_text(x.link)))
        ok = jv.string_value(x.title).isNotNull() & filled(jv.as_text(x.place)).isNotNull()
        return F.when(
            ok,
            F.struct(
                jv.string_value(x.title).alias("title"),
                location_text(x.place).alias("location"),
                F.when(url != "", absolutize_url(base, url)).otherwise("").alias("url"),
            ),
        )

    def parts(m: Column) -> Column:
        return F.struct(
            jv.first_truthy(m, lex.SIMPLE_TITLE_KEYS).alias("title"),
            jv.first_truthy(m, lex.SIMPLE_PLACE_KEYS).alias("place"),
            jv.first_truthy(m, lex.SIMPLE_URL_KEYS).alias("link"),
        )

    return let(jv.as_map(v), lambda m: let(parts(m), of))


def _first_jobs(jobs: Column) -> Column:
    """Keep the first job per URL, else per title and location."""

    def key(j: Column) -> Column:
        return F.coalesce(F.nullif(j.url, F.lit("")), F.concat(j.title, F.lit("|"), j.location))

    return let(F.filter(jobs, lambda j: j.isNotNull()), lambda js: first_by(js, key))


def extract_listing_jobs(responses: DataFrame, base: str = "base_url", body: str = "body") -> DataFrame:
    """Adds ``jobs`` and the flags ``has_list_key``, ``from_list``, ``has_fields``.

    Payloads without a job list are searched for job objects at any depth.
    """
    v, base_col = F.col("_v"), F.col(base)

    def jobs_of(values: Column) -> Column:
        found = _first_jobs(F.transform(values, lambda x: _simple_job(x, base_col)).cast(_JOB))
        return let(found, lambda js: F.when(F.size(js) > 0, js))

    keyed = F.filter(
        F.transform(lit_array(lex.SIMPLE_LIST_KEYS), lambda k: jv.as_list(F.try_element_at(jv.as_map(v), k))),
        lambda x: x.isNotNull(),
    )
    no_lists = F.array().cast("array<array<variant>>")
    # A list at the top counts as one more list to try, but not as a list key.
    tried = F.concat(F.col("_lists"), F.when(jv.is_array(v), F.array(jv.as_list(v))).otherwise(no_lists))
    first_list = F.try_element_at(
        F.filter(F.transform(tried, jobs_of), lambda js: js.isNotNull()), F.lit(1)
    )
    keys = (lex.SIMPLE_TITLE_KEYS, lex.SIMPLE_PLACE_KEYS)
    known = (*lex.SIMPLE_TITLE_KEYS, *lex.SIMPLE_PLACE_KEYS, *lex.SIMPLE_URL_KEYS)
    tried_lists = (
        responses.withColumn("_v", jv.parse(F.col(body)))
        .withColumn("_lists", F.coalesce(keyed, no_lists))
        .withColumn("_listed", first_list)
        .withColumn("has_list_key", F.size("_lists") > 0)
        .withColumn("_unlisted", F.when(F.col("_listed").isNull() & v.isNotNull(), F.col(body)))
        .drop("_v", "_lists")
    )
    return (
        jv.nested_objects(tried_lists, "_unlisted", "_found", keys, known)
        .withColumn("jobs", F.coalesce("_listed", jobs_of(F.transform("_found", jv.parse)), F.array().cast(_JOB)))
        .withColumn("from_list", F.col("_listed").isNotNull())
        .withColumn("has_fields", F.size("jobs") > 0)
        .drop("_listed", "_found", "_unlisted")
    )


def board_postings(responses: DataFrame, body: str = "body") -> DataFrame:
    """Postings of a board payload; the raw object stays as text."""
    kept = [c for c in responses.columns if c != body]
    v = F.col("_v")
    place = jv.field(v, "location")
    return (
        responses.select(
            *kept,
            F.posexplode(jv.as_list(jv.field(jv.parse(F.col(body)), "jobs"))).alias("pos", "_v"),
        )
        .where(jv.is_object(v))
        .select(
            *kept,
            "pos",
            or_empty(filled(jv.as_text(jv.field(v, "title")))).alias("title"),
            or_empty(
                F.when(jv.is_object(place), jv.as_text(jv.field(place, "name"))).otherwise(
                    F.when(jv.truthy(place), jv.as_text(place))
                )
            ).alias("location"),
            or_empty(filled(jv.as_text(jv.field(v, "absolute_url")))).alias("url"),
            jv.text_of(v).alias("raw"),
        )
        .where((F.col("title") != "") & (F.col("url") != ""))
    )


def workday_postings(responses: DataFrame, site_url: str = "site_url", body: str = "body", join_urls: bool = False) -> DataFrame:
    """Postings of a Workday payload; ``join_urls`` is the older mapper."""
    kept = [c for c in responses.columns if c != body]
    v, site = F.col("_v"), F.col(site_url)
    path = or_empty(jv.as_text(jv.first_truthy(jv.as_map(v), ("externalPath",))))
    place = jv.first_truthy(jv.as_map(v), ("locationsText", "location"))
    if join_urls:
        bullet = jv.first_truthy(jv.as_map(jv.field(v, "bulletFields")), ("url",))
        link = F.coalesce(F.nullif(path, F.lit("")), jv.as_text(bullet))
        url = F.when(link.isNotNull(), absolutize_url(site, link))
    else:
        url = F.when(
            (workday_tenant(site) != "") & (workday_site(site) != ""),
            workday_job_url(workday_tenant(site), workday_site(site), path),
        )
    return (
        responses.select(
            *kept,
            F.posexplode(jv.as_list(jv.field(jv.parse(F.col(body)), "jobPostings"))).alias("pos", "_v"),
        )
        .where(jv.is_object(v))
        .select(
            *kept,
            "pos",
            or_empty(filled(jv.as_text(jv.field(v, "title")))).alias("title"),
            strip(or_empty(jv.as_text(place))).alias("location"),
            url.alias("url"),
            jv.text_of(v).alias("raw"),
        )
        .where((F.col("title") != "") & F.col("url").isNotNull())
    )


# --- D31 - D33: model replies and prompts -----------------------------------


def unfence(content: Column) -> Column:
    """Reply text without a Markdown fence around it."""
    text = strip(content)
    inner = F.btrim(text, F.lit("`"))
    inner = F.when(inner.contains("\n"), F.regexp_replace(inner, r"^[^\n]*\n", "")).otherwise(inner)
    cut = F.when(
        inner.contains("```"), F.regexp_replace(inner, r"(?s)^(.*)```.*$", "$1")
    ).otherwise(inner)
    return F.when(text.startswith("```"), cut).otherwise(text)


def token_usage(replies: DataFrame, input_text: str | None = None) -> DataFrame:
    """Counts from the reply, zero when absent; without any, a quarter of the input length."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    if all(n in replies.columns for n in names):
        counts = [F.coalesce(F.col(n).cast("long"), F.lit(0)) for n in names]
    else:
        estimate = F.floor(F.length(or_empty(F.col(input_text or "content"))) / 4)
        counts = [estimate, F.lit(0).cast("long"), estimate]
    return replies.withColumns(
        dict(zip(("input_tokens", "output_tokens", "total_tokens"), counts, strict=True))
    )


def parse_replies(replies: DataFrame, content: str = "content") -> DataFrame:
    """Typed reply columns; a reply that is not a JSON object gives the empty record."""
    v = F.col("_v")
    parsed = jv.parse(unfence(F.col(content)))
    strings = ("title", "company_name", "employment_type", "posted_on", "remote_type", "job_id")
    lists = (
        "skills", "required_skills", "preferred_skills", "soft_skills", "inferred_skills",
        "qualifications", "certifications", "tools_and_technologies",
    )
    # One expression per kind of field, applied to all fields of that kind.
    fields = {
        "_strings": F.transform(F.array(*[jv.field(v, n) for n in strings]), jv.scalar_text),
        "_lists": F.transform(F.array(*[jv.field(v, n) for n in lists]), lambda x: records.norm_list(x)),
        "location": let(jv.field(v, "location"), records.norm_location),
        "experience": let(jv.field(v, "experience"), records.norm_experience),
        "salary": let(jv.field(v, "salary"), records.norm_salary),
        "education": let(jv.field(v, "education"), records.norm_education),
        "additional_sections": records.norm_sections(jv.field(v, "additional_sections")),
        "is_valid": v.isNotNull(),
    }
    named = {n: F.col("_strings")[i] for i, n in enumerate(strings)}
    named |= {n: F.col("_lists")[i] for i, n in enumerate(lists)}
    named |= {n: lit_array([]) for n in ("key_responsibilities", "benefits")}
    named |= {n: F.lit("") for n in ("job_description", "description", "about_company")}
    return (
        replies.withColumn("_v", F.when(jv.is_object(parsed), parsed))
        .withColumns(fields)
        .withColumns(named)
        .drop("_v", "_strings", "_lists")
    )


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _indented(entries: Column) -> Column:
    """A string map as JSON with one indented line per entry."""
    lines = F.transform(
        F.map_entries(entries),
        lambda e: F.concat(F.lit("  "), _quoted(e.key), F.lit(": "), _quoted(e.value)),
    )
    return F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def known_hint(known: Column) -> Column:
    """Hint block listing the fields already known; empty when there are none."""
    filled_only = F.map_filter(known, lambda _, x: or_empty(x) != "")
    return F.when(
        F.size(filled_only) > 0,
        F.concat(
            F.lit("Already confirmed (use these as-is, do NOT contradict):\n"),
            _indented(filled_only),
            F.lit("\n\n"),
        ),
    ).otherwise("")


_RULE = "-" * 34
_INPUT_HEADS = {
    "full": "INPUT (FULL job posting - NO FILTERING APPLIED):\n",
    "workday": "INPUT (FULL Workday job posting - NO FILTERING APPLIED):\n",
    "filtered": "INPUT (filtered to relevant job content):\n",
}


def build_prompts(
    pages: DataFrame,
    known: str = "known",
    mode: str = "full",
    text: str = "text",
    summary: str = "summary",
    chunks: str = "chunks",
) -> DataFrame:
    """Prompt per page: hint, then the whole text or the summary and numbered chunks."""
    if mode == "filtered":
        sections = F.transform(
            F.col(chunks),
            lambda c, i: F.concat(F.lit("SECTION "), (i + 1).cast("string"), F.lit(":\n"), c),
        )
        head = F.when(
            or_empty(F.col(summary)) != "",
            F.array(F.concat(F.lit("JOB SUMMARY:\n"), F.left(summary, F.lit(1200)))),
        ).otherwise(lit_array([]))
        body = F.array_join(F.concat(head, sections), "\n\n---\n\n")
    else:
        body = or_empty(F.col(text))
    prompt = F.concat(
        known_hint(F.col(known)),
        F.lit(f"{_RULE}\n\n{_INPUT_HEADS[mode]}"),
        body,
        F.lit(f"\n\n{_RULE}\n\nOUTPUT:"),
    )
    return pages.withColumn("prompt", prompt)


# --- D34 --------------------------------------------------------------------


def request_template(best: DataFrame, requests: DataFrame, site: str = "site") -> DataFrame:
    """Request behind the best response of every site.

    ``best`` holds one row per site, so the join grows with the requests only. Of the
    matching requests the first wins, by a map-side combined minimum.
    """
    r, q = best.alias("r"), requests.alias("q")
    either = F.col("r.url").startswith(F.col("q.url")) | F.col("q.url").startswith(F.col("r.url"))
    hits = (
        r.join(q, (F.col(f"r.{site}") == F.col(f"q.{site}")) & either)
        .groupBy(F.col(f"r.{site}").alias(site))
        .agg(
            F.min_by(
                F.struct("q.method", F.to_json("q.headers").alias("headers"), "q.post_data"), "q.seq"
            ).alias("_hit")
        )
    )
    return best.join(hits, site, "left").select(
        *best.columns,
        F.coalesce("_hit.method", F.lit("GET")).alias("method"),
        F.coalesce(
            F.from_json("_hit.headers", "map<string,string>"), F.create_map().cast("map<string,string>")
        ).alias("headers"),
        F.nullif("_hit.post_data", F.lit("")).alias("payload"),
        jv.parse(F.col("_hit.post_data")).isNotNull().alias("payload_is_json"),
    )


