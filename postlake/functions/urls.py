"""URL and key expressions. All are plain Column expressions: no UDF, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.functions.text import any_contains, filled, first_match, let, or_empty, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NO_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def normalize_site_url(c: Column) -> Column:
    """Trimmed URL with a scheme; empty and null become the empty string."""
    trimmed = strip(or_empty(c))
    return (
        F.when(trimmed == "", F.lit(""))
        .when(trimmed.startswith("http://") | trimmed.startswith("https://"), trimmed)
        .otherwise(F.concat(F.lit("https://"), trimmed))
    )


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def url_netloc(c: Column) -> Column:
    return F.regexp_extract(c, _NO_SCHEME + r"//([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, _NO_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def url_fragment(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^#]*#(.*)$", 1)


def get_domain(c: Column) -> Column:
    return F.lower(url_netloc(normalize_site_url(c)))


def get_origin(c: Column) -> Column:
    return let(
        normalize_site_url(c), lambda site: F.concat(url_scheme(site), F.lit("://"), url_netloc(site))
    )


def path_segments(c: Column) -> Column:
    return F.filter(F.split(url_path(c), "/"), lambda s: s != "")


def _fold_dots(segments: Column) -> Column:
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(
        F.element_at(segments, -1).isin(".", ".."), F.array_append(folded, F.lit(""))
    ).otherwise(folded)


def _drop_inner_empty(segments: Column) -> Column:
    last = F.size(segments) - 1
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == last))


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        scheme,
        F.lit("://"),
        netloc,
        rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _split_url(c: Column) -> Column:
    return F.struct(
        url_scheme(c).alias("scheme"),
        url_netloc(c).alias("host"),
        url_path(c).alias("path"),
        url_query(c).alias("query"),
        url_fragment(c).alias("fragment"),
    )


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Path of a relative link below the folder of ``base_path``, dot segments folded."""
    folder = F.split(F.regexp_replace(base_path, r"(?<=/)[^/]+$|^[^/]+$", ""), "/")
    own = F.split(path, "/")
    # The folder ends in an empty segment, which dropping inner empties removes again.
    below = let(F.concat(folder, own), _drop_inner_empty)
    joined = let(
        F.when(path.startswith("/"), own).otherwise(below), lambda s: F.array_join(_fold_dots(s), "/")
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("/"))


def absolutize_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against a site URL the way RFC 3986 does."""

    def resolve(x: Column) -> Column:
        b, r = x.b, x.r
        scheme = F.coalesce(F.nullif(r.scheme, F.lit("")), b.scheme)
        return (
            F.when(x.site == "", x.href)
            .when(x.link == "", x.site)
            .when(scheme != b.scheme, x.href)
            .when(r.host != "", _unsplit(scheme, r.host, r.path, r["query"], r.fragment))
            .when(
                r.path == "",
                _unsplit(
                    scheme,
                    b.host,
                    b.path,
                    F.when(r["query"] == "", b["query"]).otherwise(r["query"]),
                    r.fragment,
                ),
            )
            .otherwise(_unsplit(scheme, b.host, _merge_paths(b.path, r.path), r["query"], r.fragment))
        )

    texts = F.struct(
        normalize_site_url(base).alias("site"),
        F.translate(or_empty(href), "\t\r\n", "").alias("link"),
        or_empty(href).alias("href"),
    )
    return let(
        texts,
        lambda x: let(
            F.struct(
                x.site.alias("site"),
                x.link.alias("link"),
                x.href.alias("href"),
                _split_url(x.site).alias("b"),
                _split_url(x.link).alias("r"),
            ),
            resolve,
        ),
    )


def looks_like_api_url(c: Column, tokens: Sequence[str] = lex.API_URL_TOKENS) -> Column:
    return any_contains(F.lower(or_empty(c)), tokens)


def _decode(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def url_facets(c: Column, ignored: tuple[str, ...] = lex.PAGING_PARAMS) -> Column:
    """Query parameters as ``map<string, array<string>>`` without the paging ones."""
    pairs = F.transform(
        F.split(url_query(c), "&"),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
            strip(_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1))).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p.v != "") & ~F.lower(p.k).isin(*ignored))
    keys = F.array_distinct(F.transform(kept, lambda p: p.k))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"),
                F.transform(F.filter(kept, lambda p: p.k == k), lambda p: p.v).alias("value"),
            ),
        )
    )


def workday_job_url(tenant: Column, site: Column, external_path: Column) -> Column:
    path = F.ltrim(strip(external_path), F.lit("/"))
    return F.when(
        path != "",
        F.format_string("https://%s.wd1.myworkdayjobs.com/en-US/%s/job/%s", tenant, site, path),
    )


def workday_tenant(c: Column) -> Column:
    return F.substring_index(url_netloc(normalize_site_url(c)), ".", 1)


def workday_site(c: Column) -> Column:
    return or_empty(F.try_element_at(path_segments(normalize_site_url(c)), F.lit(1)))


def normalize_workday_url(c: Column) -> Column:
    """Public page URL: no doubled ``/job``, locale present, no query or fragment."""
    path = F.regexp_replace(url_path(c), r"(/job)/job/[^/]+/([^/]+)$", "$1/$2")
    path = F.regexp_replace(path, r"(/job){2,}/", "$1/")
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    with_locale = F.concat(
        F.lit("/"), parts[0], F.lit("/en-US/"), F.array_join(F.slice(parts, 2, F.size(parts)), "/")
    )
    needs_locale = (
        ~path.contains("/en-US/") & (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(2)) == "job")
    )
    return _unsplit(
        url_scheme(c),
        url_netloc(c),
        F.when(needs_locale, with_locale).otherwise(path),
        F.lit(""),
        F.lit(""),
    )


def workday_job_id(c: Column) -> Column:
    url = F.rtrim(c, F.lit("/"))
    return F.coalesce(
        F.nullif(F.regexp_extract(url, r"_([A-Za-z]?\d+[-\w]*)$", 0), F.lit("")), last_segment(url)
    )


def job_id_from_url(c: Column) -> Column:
    return or_empty(first_match(c, [(p, 1) for p in lex.URL_ID_PATTERNS]))


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def fallback_id(job_id: Column, url: Column) -> Column:
    return F.coalesce(filled(job_id), last_segment(url))


