"""Normalising record fields, and the whole detail pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import jsonv as jv
from postlake.functions import lexicons as lex
from postlake.functions.text import filled, lit_array, or_empty, strip

LIST_CAP = 15
SECTION_TYPE = "array<struct<section_title:string,content:string>>"


def distinct_ci(c: Column, cap: int | None = LIST_CAP) -> Column:
    """Distinct strings ignoring case: first spelling, first-seen order, at most ``cap``."""
    cleaned = F.filter(F.transform(c, strip), lambda s: s != "")

    def full(acc: Column) -> Column:
        return F.size(acc) >= cap if cap else F.lit(False)

    firsts = F.aggregate(
        cleaned,
        lit_array([]),
        lambda acc, s: F.when(full(acc) | F.exists(acc, lambda k: F.lower(k) == F.lower(s)), acc).otherwise(
            F.array_append(acc, s)
        ),
    )
    return firsts


def _texts(v: Column) -> Column:
    """Non-empty scalar texts of an array value."""
    return F.filter(F.transform(jv.as_list(v), jv.scalar_text), lambda s: s != "")


def _joined_list(v: Column) -> Column:
    return F.array_join(_texts(v), ", ")


def norm_location(v: Column) -> Column:
    """Null, string, list or address object to an array of strings."""
    parts = [
        F.nullif(jv.scalar_text(jv.field(v, k)), F.lit(""))
        for k in ("addressLocality", "addressRegion", "addressCountry", "name")
    ]
    combined = F.concat_ws(", ", *parts)
    one = jv.scalar_text(v)
    return (
        F.when(jv.is_array(v), _texts(v))
        .when(jv.is_object(v) & (combined != ""), F.array(combined))
        .when(~jv.is_object(v) & (one != ""), F.array(one))
        .otherwise(lit_array([]))
    )


def norm_experience(v: Column) -> Column:
    value = jv.field(v, "value")
    return (
        F.when(
            jv.is_object(v),
            or_empty(
                F.coalesce(
                    *[
                        F.nullif(jv.scalar_text(x), F.lit(""))
                        for x in (jv.field(value, "minValue"), value, jv.field(v, "description"))
                    ]
                )
            ),
        )
        .when(jv.is_array(v), _joined_list(v))
        .otherwise(jv.scalar_text(v))
    )


def norm_salary(v: Column) -> Column:
    value = jv.field(v, "value")
    bounds = [F.nullif(jv.scalar_text(jv.field(value, k)), F.lit("")) for k in ("minValue", "maxValue")]
    span = F.concat_ws("-", *bounds)
    priced = F.when(
        span != "", strip(F.concat(jv.scalar_text(jv.field(v, "currency")), F.lit(" "), span))
    ).otherwise("")
    loose = F.coalesce(F.nullif(jv.scalar_text(value), F.lit("")), jv.scalar_text(jv.field(v, "text")))
    return (
        F.when(jv.is_object(v) & (value.isNull() | jv.is_object(value)), priced)
        .when(jv.is_object(v), loose)
        .when(jv.is_array(v), _joined_list(v))
        .otherwise(jv.scalar_text(v))
    )


def norm_education(v: Column) -> Column:
    named = F.coalesce(
        F.nullif(jv.scalar_text(jv.field(v, "credentialCategory")), F.lit("")),
        jv.scalar_text(jv.field(v, "description")),
    )
    return F.when(jv.is_array(v), _joined_list(v)).when(jv.is_object(v), named).otherwise(jv.scalar_text(v))


def norm_list(v: Column, cap: int = LIST_CAP) -> Column:
    """Distinct list of a VARIANT: lists are cleaned, a truthy scalar becomes one element."""
    return (
        F.when(jv.is_array(v), distinct_ci(_texts(v), cap))
        .when(jv.truthy(v), F.array(jv.scalar_text(v)))
        .otherwise(lit_array([]))
    )


def norm_lists(df: DataFrame, fields: Sequence[str] = lex.LIST_FIELDS, cap: int = LIST_CAP) -> DataFrame:
    """Clean every list field of a typed frame; missing fields become empty lists."""
    listed = [
        n for n in fields if n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType)
    ]
    # One expression cleans all list columns.
    cleaned = F.transform(F.array(*listed), lambda c: F.coalesce(distinct_ci(c, cap), lit_array([])))
    out = {n: F.col("_lists")[i] for i, n in enumerate(listed)}
    for name in (n for n in fields if n not in listed):
        if name in df.columns:
            text = or_empty(F.col(name).cast("string"))
            out[name] = F.when(text != "", F.array(strip(text))).otherwise(lit_array([]))
        else:
            out[name] = lit_array([])
    return df.withColumn("_lists", cleaned).withColumns(out).drop("_lists") if listed else df.withColumns(out)


def norm_sections(v: Column) -> Column:
    """Section objects of a VARIANT list with two clean string fields."""
    return F.coalesce(
        F.transform(
            F.filter(jv.as_list(v), jv.is_object),
            lambda s: F.struct(
                jv.scalar_text(jv.field(s, "section_title")).alias("section_title"),
                jv.scalar_text(jv.field(s, "content")).alias("content"),
            ),
        ),
        F.array().cast(SECTION_TYPE),
    )


def norm_strings(df: DataFrame, fields: Sequence[str] = lex.STRING_FIELDS) -> DataFrame:
    """Trimmed text, null to empty, numbers to text; nested values to empty."""
    out = {}
    for name in fields:
        kind = df.schema[name].dataType if name in df.columns else None
        if kind is None or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            out[name] = F.lit("")
        elif isinstance(kind, T.VariantType):
            out[name] = jv.scalar_text(F.col(name))
        else:
            out[name] = strip(or_empty(F.col(name).cast("string")))
    return df.withColumns(out)


def strip_large(df: DataFrame) -> DataFrame:
    """Without the large text fields; only short sections stay."""
    out = df.drop("job_description", "description", "about_company")
    if "additional_sections" not in df.columns:
        return out
    return out.withColumn(
        "additional_sections",
        F.filter(
            "additional_sections",
            lambda s: (F.length(s.content) < 200) & (F.length(s.section_title) < 100),
        ),
    )


def extract_details(
    pages: DataFrame, replies: DataFrame | None = None, force: bool = False, page_id: str = "page_id"
) -> DataFrame:
    """Pages and model replies in, cleaned detail records out.

    Every page is parsed once. The markup parse is only evaluated where structured data
    scores zero. Html and dom never reach the join with the replies.
    """
    from postlake.operators.fields import page_posting, parsed_record, posting_fields
    from postlake.operators.html import HIDE_PARSER, dom_text, read_markup
    from postlake.operators.merge import merge_enrichment
    from postlake.operators.payloads import parse_replies, token_usage
    from postlake.operators.signals import confidence, record_score

    kept = [c for c in pages.columns if c != "html"]
    base = (
        read_markup(pages, index=True)
        .withColumn("_found", page_posting(F.col("dom")))
        .withColumn("_posting", posting_fields(F.col("_found")))
        .withColumn("_text", dom_text(F.col("dom"), HIDE_PARSER))
        .withColumn("_empty", record_score(F.col("_posting")) == 0)
        .withColumn(
            "_r",
            F.when(F.col("_empty"), parsed_record(F.col("dom"), F.col("_text"))).otherwise(
                F.col("_posting")
            ),
        )
        .select(
            *kept,
            "_r.*",
            F.when(F.col("_empty"), F.lit("html_basic")).otherwise("json_ld").alias("parser_used"),
        )
    )
    base = base.withColumn("_asked", F.lit(force) | (confidence() < 4))
    if replies is not None:
        delta = token_usage(parse_replies(replies)).drop("content")
        fields = [c for c in lex.REPLY_PRIORITY_FIELDS if c in delta.columns]
        gaps = [c for c in ("title", "company_name", "location", "description") if c in delta.columns]
        extra = ["input_tokens", "output_tokens", "total_tokens"]
        slim = delta.select(page_id, *fields, *[c for c in gaps if c != "location"], F.array_join("location", ", ").alias("location"), F.col("location").alias("_places"), *extra)
        joined = base.join(
            slim.select(F.col(page_id), F.struct(*[c for c in slim.columns if c != page_id]).alias("_d")),
            page_id,
            "left",
        ).withColumn("_d", F.when(F.col("_asked"), F.col("_d")))
        merged = merge_enrichment(
            joined, "_d", [*fields, *gaps], priority=lex.REPLY_PRIORITY_FIELDS
        ).withColumns(
            {
                "ai_used": F.col("_asked"),
                "ai_usage": F.struct(
                    *[F.coalesce(F.col(f"_d.{c}"), F.lit(0).cast("long")).alias(c) for c in extra]
                ),
                "_places": F.col("_d._places"),
            }
        )
    else:
        zero = F.lit(0).cast("long")
        merged = base.withColumns(
            {
                "ai_used": F.lit(False),
                "ai_usage": F.struct(
                    zero.alias("input_tokens"), zero.alias("output_tokens"), zero.alias("total_tokens")
                ),
                "_places": lit_array([]),
                "additional_sections": F.array().cast(SECTION_TYPE),
                "education": F.lit(""),
                "remote_type": F.lit(""),
                "job_id": F.lit(""),
            }
        )
    own = filled(F.col("location"))
    scored = merged.withColumn("_score", confidence())
    normal = norm_strings(norm_lists(scored)).withColumns(
        {
            # A reply may name several places; they replace the joined text used for merging.
            "location": F.when(own.isNull(), lit_array([]))
            .when(own == F.array_join(F.coalesce("_places", lit_array([])), ", "), F.col("_places"))
            .otherwise(F.array(own)),
            "experience": or_empty(strip(F.col("experience"))),
            "salary": or_empty(strip(F.col("salary"))),
            "education": or_empty(strip(F.col("education"))),
            "remote_type": or_empty(strip(F.col("remote_type"))),
            "job_id": or_empty(strip(F.col("job_id"))),
            "additional_sections": F.coalesce("additional_sections", F.array().cast(SECTION_TYPE)),
            "_meta": F.struct(
                "parser_used",
                F.col("_score").alias("confidence"),
                "ai_used",
                F.lit(force).alias("ai_forced"),
            ),
        }
    )
    return strip_large(normal).drop("_asked", "_d", "_places", "_score", "parser_used", "ai_used")
