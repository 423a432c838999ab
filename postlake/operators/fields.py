"""Posting fields from structured data, markup and plain text. Null means no match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import jsonv as jv
from postlake.functions import lexicons as lex
from postlake.functions.text import (
    filled,
    first_match,
    join_filled,
    let,
    lit_array,
    or_empty,
    strip,
)
from postlake.functions.terms import terms_in
from postlake.functions.urls import job_id_from_url
from postlake.operators.html import (
    HIDE_NONE,
    HIDE_PARSER,
    dom_text,
    element_text,
    first_element,
    ld_json_array,
    positions,
    read_markup,
    selector_text,
)

# --- Structured data (D1 - D6) ----------------------------------------------


def _is_posting(v: Column) -> Column:
    kind = jv.text_of(jv.field(v, "@type"))
    return F.coalesce(kind.contains("JobPosting"), F.lit(False))


def find_posting_in(docs: Column) -> Column:
    """First posting, in block and item order, of an ``array<variant>`` of documents.

    A level replaces every other object by its ``@graph`` children in place, so the order
    of a depth-first walk is kept; postings themselves are not opened. There are as many
    levels as a document names ``@graph``, so none is too deep.
    """
    nodes = F.flatten(F.transform(docs, lambda d: F.coalesce(jv.as_list(d), F.array(d))))
    graphs = F.array_max(F.transform(docs, lambda d: F.size(F.split(F.to_json(d), '"@graph"')) - 1))
    levels = F.when(graphs > 0, F.sequence(F.lit(1), graphs)).otherwise(F.array().cast("array<int>"))

    def opened(level: Column) -> Column:
        return F.flatten(
            F.transform(
                level,
                lambda n: F.when(_is_posting(n), F.array(n)).otherwise(
                    F.coalesce(jv.as_list(jv.field(n, "@graph")), F.array().cast("array<variant>"))
                ),
            )
        )

    found = F.aggregate(levels, nodes, lambda level, _: opened(level))
    return F.try_element_at(F.filter(found, _is_posting), F.lit(1))


def page_posting(dom: Column) -> Column:
    """Posting of a parsed page as a VARIANT, null when it has none."""
    docs = F.filter(F.transform(ld_json_array(dom), jv.parse), lambda d: d.isNotNull())
    return find_posting_in(docs)


def find_posting(blocks: DataFrame, page_id: str = "page_id") -> DataFrame:
    """One posting per page from a block table; the first block with one wins."""
    hits = blocks.select(page_id, "pos", find_posting_in(F.array("doc")).alias("posting")).where(
        F.col("posting").isNotNull()
    )
    return hits.groupBy(page_id).agg(F.min_by("posting", "pos").alias("posting"))


def _loose(v: Column) -> Column:
    """Text of any value, null when absent or blank; objects give their JSON text."""
    return F.when(F.coalesce(jv.text_of(v) != "null", F.lit(False)), filled(jv.as_text(v)))


def _get(v: Column, key: str) -> Column:
    return _loose(jv.field(v, key))


def _address(v: Column) -> Column:
    return join_filled(", ", *[_get(v, k) for k in ("addressLocality", "addressRegion", "addressCountry")])


def _location(place: Column) -> Column:
    return F.coalesce(
        _address(jv.field(place, "address")),
        _get(place, "name"),
        jv.string_value(place),
    )


def posting_location(posting: Column) -> Column:
    return let(jv.field(posting, "jobLocation"), _location)


def _salary(pay: Column) -> Column:
    def priced(value: Column) -> Column:
        bounds = F.transform(
            F.array(jv.field(value, "minValue"), jv.field(value, "maxValue")),
            lambda b: F.when(jv.truthy(b), jv.as_text(b)),
        )
        span = F.nullif(F.array_join(bounds, "-"), F.lit(""))
        return strip(F.concat(or_empty(jv.as_text(jv.field(pay, "currency"))), F.lit(" "), span))

    return F.coalesce(let(jv.field(pay, "value"), priced), _get(pay, "text"))


def posting_salary(posting: Column) -> Column:
    return let(jv.field(posting, "baseSalary"), _salary)


def split_list(c: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, sep), strip), lambda s: s != "")


def _skill_list(skills: Column) -> Column:
    listed = F.filter(F.transform(jv.as_list(skills), _loose), lambda s: s.isNotNull())
    return F.coalesce(
        listed, F.when(jv.is_string(skills), split_list(jv.as_text(skills))), lit_array([])
    )


def posting_skills(posting: Column) -> Column:
    return let(jv.field(posting, "skills"), _skill_list)


def _named(v: Column) -> Column:
    """Name or id of an object, or the value itself."""
    return F.when(jv.is_object(v), F.coalesce(_get(v, "name"), _get(v, "@id"))).otherwise(
        F.when(jv.truthy(v), _loose(v))
    )


# Fields that are plain texts, read by one expression.
_POSTING_TEXTS = (
    "title", "description", "experienceRequirements", "baseSalary", "employmentType",
    "datePosted", "validThrough",
)


def _posting_texts(posting: Column) -> Column:
    return F.transform(F.array(*[jv.field(posting, k) for k in _POSTING_TEXTS]), _loose)


def posting_fields(posting: Column) -> Column:
    """The nine-field record of a posting object."""

    def record(texts: Column) -> Column:
        title, description, experience, pay, kind, posted, valid = (
            texts[i] for i in range(len(_POSTING_TEXTS))
        )
        return F.struct(
            title.alias("title"),
            let(jv.field(posting, "hiringOrganization"), _named).alias("company_name"),
            posting_location(posting).alias("location"),
            description.alias("description"),
            posting_salary(posting).alias("salary"),
            F.coalesce(experience, pay).alias("experience"),
            F.lower(kind).alias("employment_type"),
            F.coalesce(posted, valid).alias("posted_on"),
            posting_skills(posting).alias("skills"),
        )

    return let(_posting_texts(posting), record)


def posting_fields_light(posting: Column, url: Column) -> Column:
    """Nine-field record of the light scrape: other location and salary sources, no nulls."""

    def place_name(place: Column) -> Column:
        return F.when(jv.is_object(place), _get(place, "name")).otherwise(_loose(place))

    def pay_text(pay: Column) -> Column:
        least = _get(jv.field(pay, "value"), "minValue")
        return F.when(jv.is_object(pay), least).otherwise(_loose(pay))

    def record(texts: Column) -> Column:
        title, description, experience, _pay, kind, posted, _valid = (
            texts[i] for i in range(len(_POSTING_TEXTS))
        )
        address = jv.field(posting, "jobLocationAddress")
        place = F.when(address.isNull() | jv.is_object(address), _address(address)).otherwise(
            let(jv.field(posting, "jobLocation"), place_name)
        )
        company = let(jv.field(posting, "hiringOrganization"), place_name)
        return F.struct(
            or_empty(title).alias("title"),
            or_empty(company).alias("company_name"),
            url.alias("job_link"),
            or_empty(place).alias("location"),
            or_empty(experience).alias("experience"),
            or_empty(let(jv.field(posting, "baseSalary"), pay_text)).alias("salary"),
            or_empty(description).alias("job_summary"),
            F.coalesce(F.lower(kind), F.lit("unknown")).alias("remote_type"),
            or_empty(posted).alias("posted_on"),
        )

    return let(_posting_texts(posting), record)


# --- Markup (D7 - D10, D17) -------------------------------------------------


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    return F.try_element_at(lines, F.lit(1))


def html_title(dom: Column, text: Column, tags: Sequence[str] = ("h1", "h2"), hide: int = HIDE_PARSER) -> Column:
    """First heading longer than three characters, else the first line of text."""

    def heading(tag: str) -> Column:
        texts = F.transform(positions(dom, tag, hide), lambda p: element_text(dom, F.get(dom.els, p), hide, " "))
        return F.get(F.filter(texts, lambda t: F.length(t) > 3), F.lit(0))

    return F.coalesce(*[heading(tag) for tag in tags], first_line(text))


def html_company(dom: Column, text: Column, selectors: Sequence[str] = lex.COMPANY_SELECTORS) -> Column:
    at, hiring = (first_match(text, [(p, 1)]) for p in lex.COMPANY_PATTERNS)
    # The second pattern tries every capital letter; most texts lack the words it ends in.
    return F.coalesce(
        selector_text(dom, selectors, HIDE_PARSER), at, F.when(text.rlike(lex.COMPANY_HINT), hiring)
    )


def html_location(dom: Column, text: Column, selectors: Sequence[str] = lex.LOCATION_SELECTORS) -> Column:
    sized = [
        let(first_match(text, [(p, 1)]), lambda f: F.when((F.length(f) > 2) & (F.length(f) < 80), f))
        for p in lex.LOCATION_PATTERNS
    ]
    return F.coalesce(selector_text(dom, selectors, HIDE_PARSER), *sized)


def html_description(
    dom: Column,
    text: Column,
    selectors: Sequence[str] = lex.DESCRIPTION_SELECTORS,
    cap: int = 2000,
    min_len: int = 30,
) -> Column:
    picked = selector_text(dom, selectors, HIDE_PARSER, " ", min_len)
    return F.left(
        F.coalesce(picked, first_match(text, [(lex.DESCRIPTION_PATTERN % 2000, 1)])), F.lit(cap)
    )


def text_summary(
    dom: Column,
    text: Column,
    selectors: Sequence[str] = lex.DESCRIPTION_SELECTORS[:4],
    cap: int = 1000,
    hide: int = HIDE_NONE,
) -> Column:
    """Short summary; the first element found ends the search, even without text."""
    picked = selector_text(dom, selectors, hide, " ", skip_empty=False)
    return or_empty(
        F.left(F.coalesce(picked, first_match(text, [(lex.DESCRIPTION_PATTERN % 1000, 1)])), F.lit(cap))
    )


# --- Plain text (D11 - D16) -------------------------------------------------


def text_salary(text: Column, patterns: Sequence[str] = lex.SALARY_PATTERNS) -> Column:
    return first_match(text, [(p, 0) for p in patterns])


def text_experience(text: Column, patterns: Sequence[str] = lex.EXPERIENCE_PATTERNS) -> Column:
    return first_match(text, [(p, 0) for p in patterns])


def text_employment_type(text: Column, terms: Sequence[str] = lex.EMPLOYMENT_TERMS) -> Column:
    boundary = r"\p{L}\p{N}_"
    pattern = rf"(?i)(?:^|[^{boundary}])({'|'.join(terms)})(?:[^{boundary}]|$)"
    return F.lower(first_match(text, [(pattern, 1)]))


def text_posted_date(text: Column, patterns: Sequence[str] = lex.POSTED_PATTERNS) -> Column:
    return first_match(text, [(p, 1) for p in patterns])


def text_remote_type(text: Column, pattern: str = lex.REMOTE_PATTERN) -> Column:
    return F.coalesce(F.lower(first_match(text, [(pattern, 1)])), F.lit("unknown"))


def term_tags(text: Column, terms: Sequence[str] = lex.SKILL_TERMS) -> Column:
    """Sorted terms that occur as whole words, ignoring case; one pass over the text for any number of them."""
    return terms_in(F.lower(text), [t.lower() for t in terms], terms)


def tag_terms(
    docs: DataFrame, terms: Sequence[str] = lex.SKILL_TERMS, text: str = "text", name: str = "tags"
) -> DataFrame:
    return docs.withColumn(name, term_tags(F.col(text), terms))


# --- Whole pages (D18, D19) -------------------------------------------------


def parsed_record(dom: Column, text: Column, **lists: Sequence[str]) -> Column:
    """The nine-field record of a page without structured data."""
    return F.struct(
        html_title(dom, text).alias("title"),
        html_company(dom, text, lists.get("company", lex.COMPANY_SELECTORS)).alias("company_name"),
        html_location(dom, text, lists.get("location", lex.LOCATION_SELECTORS)).alias("location"),
        html_description(dom, text, lists.get("description", lex.DESCRIPTION_SELECTORS)).alias("description"),
        text_salary(text).alias("salary"),
        text_experience(text).alias("experience"),
        text_employment_type(text).alias("employment_type"),
        text_posted_date(text).alias("posted_on"),
        term_tags(text, lists.get("skills", lex.SKILL_TERMS)).alias("skills"),
    )


def parse_pages(pages: DataFrame, **lists: Sequence[str]) -> DataFrame:
    """Full record per page; keyword arguments replace the default term lists."""
    return (
        read_markup(pages, index=True)
        .withColumn("text", dom_text(F.col("dom"), HIDE_PARSER))
        .withColumn("r", parsed_record(F.col("dom"), F.col("text"), **lists))
        .select("*", "r.*")
        .drop("dom", "text", "r")
    )


def parse_pages_legacy(pages: DataFrame, url: str = "url", hide: int = HIDE_NONE) -> DataFrame:
    """Nineteen-field record of the older parser; ``hide=HIDE_PARSER`` gives the light copy."""
    dom, text, link = F.col("dom"), F.col("_text"), F.col(url)
    place = or_empty(selector_text(dom, lex.LOCATION_SELECTORS, hide, skip_empty=False))
    heading = first_element(dom, "h1", hide)
    kept = [c for c in pages.columns if c not in ("html", url)]
    none = lit_array([])
    return (
        read_markup(pages, keep_html=True, index=True)
        .withColumn("_text", dom_text(dom, hide))
        .select(
            *kept,
            or_empty(element_text(dom, heading, hide, " ")).alias("title"),
            or_empty(selector_text(dom, lex.COMPANY_SELECTORS[:4], hide, skip_empty=False)).alias(
                "company_name"
            ),
            link.alias("job_link"),
            or_empty(text_experience(text, lex.EXPERIENCE_PATTERNS[:2])).alias("experience"),
            let(place, lambda p: F.when(p != "", F.array(p)).otherwise(none)).alias("locations"),
            F.lit("").alias("educational_qualifications"),
            term_tags(text).alias("required_skill_set"),
            text_remote_type(text).alias("remote_type"),
            or_empty(text_posted_date(text, lex.POSTED_PATTERNS[:2])).alias("posted_on"),
            job_id_from_url(link).alias("job_id"),
            or_empty(text_salary(text, lex.SALARY_PATTERNS_OLD)).alias("salary"),
            F.lit(True).alias("is_active"),
            F.current_timestamp().alias("first_seen"),
            F.current_timestamp().alias("last_seen"),
            text_summary(dom, text, hide=hide).alias("job_summary"),
            none.alias("key_responsibilities"),
            none.alias("additional_sections"),
            F.lit("").alias("about_us"),
            F.to_json(
                F.struct(link.alias("url"), F.left("html", F.lit(2000)).alias("html_snippet"))
            ).alias("Scrap_json"),
        )
    )
