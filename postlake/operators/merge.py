"""Joins of parsers, replies, listings and details; keyed upserts; output records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import jsonv as jv
from postlake.functions import lexicons as lex
from postlake.functions.text import filled, lit_array, or_empty, strip
from postlake.functions.urls import fallback_id, job_id_from_url, last_segment
from postlake.operators.dedupe import dedupe_first
from postlake.operators.records import SECTION_TYPE
from postlake.operators.signals import record_score, truthy

ID_BUCKETS = 4096


# --- F1, F2 -----------------------------------------------------------------


def cascade(posting: DataFrame, parsed: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Structured data where it scores, else the markup parse.

    Both sides hold a ``record`` struct of the same fields.
    """
    left = posting.select(page_id, F.col("record").alias("_p"))
    right = parsed.select(page_id, F.col("record").alias("_h"))
    use_html = F.col("_p").isNull() | (record_score(F.col("_p")) == 0)
    return right.join(left, page_id, "left").select(
        page_id,
        F.when(use_html, F.col("_h")).otherwise(F.col("_p")).alias("record"),
        F.when(use_html, F.lit("html_basic")).otherwise("json_ld").alias("parser_used"),
    )


def merge_enrichment(
    joined: DataFrame,
    delta: str,
    fields: Sequence[str],
    priority: Sequence[str] = lex.REPLY_PRIORITY_FIELDS,
) -> DataFrame:
    """Merge the struct column ``delta`` into the frame it was joined to.

    A filled priority field of the delta wins; any other only fills a gap.
    """
    inner = joined.schema[delta].dataType
    out = {}
    for name in fields:
        new, kind = F.col(f"{delta}.{name}"), inner[name].dataType
        if name not in joined.columns:
            out[name] = F.when(truthy(new, kind), new)
            continue
        old = F.col(name)
        take = truthy(new, kind)
        if name not in priority:
            take = take & ~truthy(old, joined.schema[name].dataType)
        out[name] = F.when(take, new).otherwise(old)
    return joined.withColumns(out)


def merge_delta(
    base: DataFrame, delta: DataFrame, key: str, priority: Sequence[str] = lex.REPLY_PRIORITY_FIELDS
) -> DataFrame:
    """`merge_enrichment` for two tables with one row per key."""
    fields = [c for c in delta.columns if c != key]
    packed = delta.select(key, F.struct(*fields).alias("_delta"))
    return merge_enrichment(base.join(packed, key, "left"), "_delta", fields, priority).drop("_delta")


# --- F3 - F6 ----------------------------------------------------------------


def _detail_join(
    listings: DataFrame, details: DataFrame, key: str, order: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Listings with the first detail of their key by ``order``, or by the detail's text without one."""
    kinds = {f.name: f.dataType for f in details.schema.fields if f.name != key}
    first = dedupe_first(details, [key], list(order) or [F.to_json(F.struct(*kinds))])
    packed = first.select(key, F.struct(*kinds).alias("_detail"))
    return listings.join(packed, key, "left"), kinds


def merge_api_detail(
    listings: DataFrame,
    details: DataFrame,
    key: str = "url",
    fields: Sequence[str] = (*lex.DETAIL_FIELDS, "job_id", "location"),
    order: Sequence[str] = (),
) -> DataFrame:
    """Filled detail fields win over the listing row."""
    joined, kinds = _detail_join(listings, details, key, order)
    out = {}
    for name in fields:
        if name not in kinds:
            continue
        new = F.col(f"_detail.{name}")
        chosen = F.when(truthy(new, kinds[name]), new)
        out[name] = chosen.otherwise(F.col(name)) if name in listings.columns else chosen
    return joined.withColumns(out).drop("_detail")


def merge_dom_detail(
    listings: DataFrame, details: DataFrame, key: str = "url", order: Sequence[str] = ()
) -> DataFrame:
    """Title and location fall back to the listing; every other field is the detail's."""
    joined, kinds = _detail_join(listings, details, key, order)
    out = {}
    for name, kind in kinds.items():
        new = F.col(f"_detail.{name}")
        if name in ("title", "location") and name in listings.columns:
            out[name] = F.when(truthy(new, kind), new).otherwise(F.col(name))
        else:
            out[name] = new
    return joined.withColumns(out).drop("_detail")


def route_details(listings: DataFrame) -> DataFrame:
    """Where a listing's details come from, by strategy, raw object and site type."""
    has_raw = jv.is_object(jv.parse(F.col("raw"))) & jv.truthy(jv.parse(F.col("raw")))
    is_workday = F.col("site_type") == "WORKDAY_API"
    return listings.withColumn(
        "route",
        F.when(F.col("strategy") != "api", F.lit("page"))
        .when(has_raw & is_workday, F.lit("raw_and_page"))
        .when(has_raw, F.lit("raw"))
        .when(is_workday, F.lit("page"))
        .otherwise(F.lit("listing")),
    )


def with_defaults(
    listings: DataFrame, details: DataFrame, key: str = "url", order: Sequence[str] = ()
) -> DataFrame:
    """Every listing gives one row; without a detail it keeps its values and empties."""
    joined, kinds = _detail_join(listings, details, key, order)
    missing = F.col("_detail").isNull()
    out = {"is_default": missing}
    for name, kind in kinds.items():
        empty = empty_of(kind)
        fallback = F.coalesce(F.col(name), empty) if name in listings.columns else empty
        out[name] = F.when(missing, fallback).otherwise(F.coalesce(F.col(f"_detail.{name}"), empty))
    return joined.withColumns(out).drop("_detail")


def empty_of(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(kind)


# --- F7 - F10 ---------------------------------------------------------------


def id_bucket(keys: Sequence[str]) -> Column:
    """One of ``ID_BUCKETS`` buckets of a key hash."""
    hashed = F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("long")


def assign_ids(new: DataFrame, known: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Unique ids after the largest known id, the same on every retry.

    Rows are numbered inside ``ID_BUCKETS`` buckets of a key hash and the buckets interleave,
    so one shuffle suffices and no task ever sees all rows. ``keys`` are unique, hence buckets
    are even and the ids nearly dense.
    """
    top = known.agg(F.coalesce(F.max(id_col).cast("long"), F.lit(0).cast("long"))).scalar()
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        new.withColumn("_bucket", id_bucket(keys))
        .withColumn("_rn", F.row_number().over(inside).cast("long") - 1)
        .withColumn(id_col, top + F.col("_rn") * ID_BUCKETS + F.col("_bucket") + 1)
        .drop("_bucket", "_rn")
    )


def clean_batch(batch: DataFrame, order: str = "seq") -> DataFrame:
    """Rows with a title and a URL; the last one per site and URL."""
    rows = batch.withColumns(
        {"title": strip(or_empty(F.col("title"))), "url": strip(or_empty(F.col("url"))),
         "location": strip(or_empty(F.col("location")))}
    ).where((F.col("title") != "") & (F.col("url") != ""))
    return dedupe_first(rows, ["site_id", "url"], [F.desc(order)])


def upsert_jobs(jobs: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """New version of the job table, keyed by site and URL; known jobs keep their id."""
    key = ["site_id", "url"]
    values = ["title", "location", "raw_json"]
    fresh = clean_batch(batch, order).select(*key, F.struct(*values).alias("_new"))
    columns = ["id", "site_id", "title", "location", "url", "raw_json"]
    updated = jobs.join(fresh, key, "left").select(
        "id",
        *key,
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values],
    )
    known = updated.select(columns)
    # Only the keys of the table are read again; the batch's exchange serves both joins.
    new = fresh.join(jobs.select(*key), key, "left_anti").select(*key, "_new.*")
    added = assign_ids(new, jobs, key).select(columns)
    return known.unionByName(added)


def merge_jobs(known: DataFrame, fresh: DataFrame, base: int) -> DataFrame:
    """Known jobs and a cleaned batch, one row per site and URL, by one full join.

    Ids above ``base`` were given here: the n-th new key of a hash bucket has n * ID_BUCKETS plus its
    bucket. So the known jobs of the same buckets tell where to go on, and no other job is looked at.
    """
    key, values = ["site_id", "url"], ["title", "location", "raw_json"]
    joined = known.join(fresh.select(*key, F.struct(*values).alias("_new")), key, "full").select(
        "id",
        *key,
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values],
        id_bucket(key).alias("_bucket"),
    )
    # Within a bucket, known jobs come first; the highest number given so far is known once they are read.
    given = F.when(F.col("id") > base, F.floor((F.col("id") - base - 1) / ID_BUCKETS) + 1).otherwise(0)
    all_of = Window.partitionBy("_bucket")
    in_order = all_of.orderBy(F.col("id").isNull(), *key)
    new = F.sum(F.col("id").isNull().cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    number = F.max(given).over(all_of) + new - 1
    made = F.lit(base) + number * ID_BUCKETS + F.col("_bucket") + 1
    columns = ["id", "site_id", "title", "location", "url", "raw_json"]
    return joined.withColumn("id", F.coalesce("id", made)).select(columns)


def site_jobs(jobs: DataFrame, sites: DataFrame) -> DataFrame:
    """Jobs with their site; a plain equi join, broadcast only when Spark finds it small."""
    return jobs.join(
        sites.select(F.col("id").alias("site_id"), "domain", F.col("type").alias("site_type"), "confidence"),
        "site_id",
    )


def attach_raw(jobs: DataFrame, postings: DataFrame, keys: Sequence[str] = ("site", "url")) -> DataFrame:
    """Adds the raw object of a posting to its listing; the first posting per key is used."""
    slim = dedupe_first(postings, [*keys], ["pos"]).select(*keys, F.col("raw").alias("raw"))
    return jobs.join(slim, [*keys], "left")


# --- F11 - F14 --------------------------------------------------------------


def locations_array(v: Column) -> Column:
    """VARIANT string to a one-element list, list kept, anything else to an empty list."""
    return (
        F.when(jv.is_string(v) & (jv.as_text(v) != ""), F.array(jv.as_text(v)))
        .when(jv.is_array(v), F.transform(jv.as_list(v), jv.as_text))
        .otherwise(lit_array([]))
    )


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    empty = F.array().cast(kind) if kind.startswith("array") else F.lit("")
    return F.coalesce(F.col(name), empty) if name in df.columns else empty


def _list_text(c: Column) -> Column:
    """A list printed the way the compatible record shows it: ``['a', 'b']``."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(c, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]")
    )


def _record(
    df: DataFrame, skills: Column, education: Column, places: Column, extra: Column, keep: Sequence[str] = ()
) -> DataFrame:
    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("input_tokens", "output_tokens", "total_tokens")])
    usage = F.coalesce(F.col("ai_usage"), none) if "ai_usage" in df.columns else none
    url, job_id = _have(df, "url"), _have(df, "job_id")
    return df.select(
        *keep,
        fallback_id(job_id, url).alias("id"),
        _have(df, "title").alias("title"),
        _have(df, "company_name").alias("company_name"),
        url.alias("job_link"),
        _have(df, "experience").alias("experience"),
        places.alias("locations"),
        education.alias("educational_qualifications"),
        skills.alias("required_skill_set"),
        _have(df, "remote_type").alias("remote_type"),
        _have(df, "posted_on").alias("posted_on"),
        job_id.alias("job_id"),
        _have(df, "salary").alias("salary"),
        F.lit(True).alias("is_active"),
        F.lit("").alias("first_seen"),
        F.lit("").alias("last_seen"),
        _have(df, "additional_sections", SECTION_TYPE).alias("additional_sections"),
        jv.parse(F.to_json(extra)).alias("Scrap_json"),
        usage.alias("ai_usage"),
    )


def _education(df: DataFrame, compat: bool) -> Column:
    quals = _have(df, "qualifications", "array<string>")
    listed = _list_text(quals) if compat else F.array_join(quals, ", ")
    return F.coalesce(filled(_have(df, "education")), listed)


def _places(df: DataFrame) -> Column:
    if "location" in df.columns and isinstance(df.schema["location"].dataType, T.ArrayType):
        return F.coalesce("location", lit_array([]))
    place = _have(df, "location")
    return F.when(place != "", F.array(place)).otherwise(lit_array([]))


def _skills(df: DataFrame, compat: bool) -> Column:
    required = _have(df, "required_skills", "array<string>")
    listed = _have(df, "skills", "array<string>")
    if compat and "skills" in df.columns:
        return listed
    return F.when(F.size(required) > 0, required).otherwise(listed)


def to_record_api(details: DataFrame, compat: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The 18-field record of API details, behind the columns to keep.

    ``compat`` keeps two oddities: `skills` hides the reply's skills even when empty, and an
    empty education becomes the text of the qualification list.
    """
    extra = F.struct(
        _have(details, "url").alias("url"),
        F.lit("api").alias("strategy"),
        _have(details, "site_type").alias("site_type"),
        _have(details, "department").alias("department"),
        _have(details, "qualifications", "array<string>").alias("qualifications"),
    )
    return _record(details, _skills(details, compat), _education(details, compat), _places(details), extra, keep)


def to_record_dom(details: DataFrame, compat: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The same record for page details, with six more lists in ``Scrap_json``."""
    names = (
        "preferred_skills", "tools_and_technologies", "certifications", "soft_skills",
        "inferred_skills", "benefits",
    )
    has_meta = "_meta" in details.columns
    extra = F.struct(
        _have(details, "url").alias("url"),
        F.lit("INTERACTIVE_DOM").alias("strategy"),
        (or_empty(F.col("_meta.parser_used")) if has_meta else F.lit("")).alias("parser_used"),
        (F.coalesce(F.col("_meta.confidence"), F.lit(0)) if has_meta else F.lit(0)).alias("confidence"),
        (F.coalesce(F.col("_meta.ai_forced"), F.lit(False)) if has_meta else F.lit(False)).alias("ai_forced"),
        *[_have(details, n, "array<string>").alias(n) for n in names],
    )
    return _record(details, _skills(details, False), _education(details, compat), _places(details), extra, keep)


def to_record_legacy(details: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Older record: wrapped location, employment type as remote type, head of the page."""
    none = lit_array([])
    place = _have(details, "location") if not isinstance(
        details.schema["location"].dataType if "location" in details.columns else None, T.ArrayType
    ) else F.array_join("location", ", ")
    return details.select(
        _have(details, "title").alias("title"),
        _have(details, "company_name").alias("company_name"),
        F.col(url).alias("job_link"),
        _have(details, "experience").alias("experience"),
        F.when(place != "", F.array(place)).otherwise(none).alias("locations"),
        F.lit("").alias("educational_qualifications"),
        _have(details, "skills", "array<string>").alias("required_skill_set"),
        F.coalesce(filled(_have(details, "employment_type")), F.lit("unknown")).alias("remote_type"),
        _have(details, "posted_on").alias("posted_on"),
        job_id_from_url(F.col(url)).alias("job_id"),
        _have(details, "salary").alias("salary"),
        F.lit(True).alias("is_active"),
        F.current_timestamp().alias("first_seen"),
        F.current_timestamp().alias("last_seen"),
        _have(details, "description").alias("job_summary"),
        none.alias("key_responsibilities"),
        F.array().cast(SECTION_TYPE).alias("additional_sections"),
        F.lit("").alias("about_us"),
        jv.parse(
            F.to_json(F.struct(F.col(url).alias("url"), F.left(html, F.lit(2000)).alias("html_snippet")))
        ).alias("Scrap_json"),
    )


def empty_job(listings: DataFrame, url: str = "url") -> DataFrame:
    """Record of a page that could not be read."""
    return listings.select(
        last_segment(F.col(url)).alias("id"),
        F.lit("").alias("title"),
        F.lit("").alias("company_name"),
        F.col(url).alias("job_link"),
        F.lit("").alias("experience"),
        lit_array([]).alias("locations"),
        F.lit("unknown").alias("remote_type"),
        F.lit(True).alias("is_active"),
        jv.parse(F.to_json(F.struct(F.col(url).alias("url"), F.lit("scrape_failed").alias("error")))).alias(
            "Scrap_json"
        ),
    )


