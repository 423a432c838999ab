"""Endpoint and board candidates from sites, pages and captured URLs.

Evidence is projected out of the pages first, so html never enters a shuffle; candidates are
then combined per site by map-side aggregates on small rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.functions.text import any_contains, filled, let, lit_array, or_empty
from postlake.functions.urls import (
    absolutize_url,
    get_origin,
    normalize_site_url,
    path_segments,
    url_netloc,
    url_path,
)
from postlake.operators.dedupe import ordered_distinct, top_n_per


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(or_empty(c), pattern, group), F.lit(""))


def _own_slug(url: Column) -> Column:
    first = F.try_element_at(path_segments(url), F.lit(1))
    return F.when(url_netloc(url).endswith(lex.BOARD_HOST), first)


def _evidence(df: DataFrame, site: str, rank: int, seq: Column, slug: Column, source: Column, board: Column) -> DataFrame:
    return df.select(
        site,
        F.struct(F.lit(rank).alias("rank"), seq.cast("long").alias("seq")).alias("_at"),
        F.struct(slug.alias("slug"), source.alias("source"), board.alias("board_url")).alias("_e"),
    ).where(F.col("_e.slug").isNotNull())


def resolve_board_slug(
    sites: DataFrame, discovered: DataFrame, pages: DataFrame, fetched: DataFrame, site: str = "site"
) -> DataFrame:
    """Board slug per site from the first kind of evidence that has one.

    ``sites(site, url)``, ``discovered(site, seq, url)``, ``pages(site, html)`` and
    ``fetched(site, final_url, html)``; a site without a fetched row failed to load.
    """
    url = normalize_site_url(F.col("url"))
    zero = F.lit(0)

    def from_text(df: DataFrame, rank: int, seq: Column, text: Column, names: tuple[str, str], link: Column) -> DataFrame:
        board, param = _found(text, lex.BOARD_URL_PATTERN, 1), _found(text, lex.BOARD_PARAM_PATTERN, 1)
        return _evidence(
            df,
            site,
            rank,
            seq,
            F.coalesce(board, param),
            F.when(board.isNotNull(), F.lit(names[0])).otherwise(names[1]),
            F.when(board.isNotNull(), _found(text, lex.BOARD_URL_PATTERN, 0)).otherwise(link),
        )

    parts = [
        _evidence(sites, site, 1, zero, _own_slug(url), F.lit("direct_greenhouse_url"), url),
        from_text(
            discovered, 2, F.col("seq"), F.col("url"),
            ("browser_xhr_board_url", "browser_xhr_query_param"), F.col("url"),
        ),
        from_text(
            pages, 3, zero, F.col("html"), ("company_html_board_url", "company_html_query_param"), F.lit("")
        ),
        _evidence(
            fetched, site, 4, zero, _own_slug(F.col("final_url")), F.lit("redirect_final_url"), F.col("final_url")
        ),
        from_text(
            fetched, 5, zero, F.col("html"),
            ("fetched_html_board_url", "fetched_html_query_param"), F.col("final_url"),
        ),
        fetched.select(
            site,
            F.struct(F.lit(6).alias("rank"), zero.cast("long").alias("seq")).alias("_at"),
            F.struct(F.lit("").alias("slug"), F.lit("not_found").alias("source"), F.lit("").alias("board_url")).alias("_e"),
        ),
    ]
    best = _union(parts).groupBy(site).agg(F.min_by("_e", "_at").alias("_e"))
    return sites.join(best, site, "left").select(
        site,
        or_empty(F.col("_e.slug")).alias("slug"),
        F.coalesce("_e.source", F.lit("fetch_failed")).alias("source"),
        or_empty(F.col("_e.board_url")).alias("board_url"),
    )


def _candidates(df: DataFrame, site: str, rank: int, seq: Column, values: Column) -> DataFrame:
    """One row per element of ``values`` with its order ``(rank, seq, sub)``."""
    return df.select(
        site,
        F.lit(rank).alias("rank"),
        seq.cast("long").alias("seq"),
        F.posexplode(values).alias("sub", "candidate"),
    )


def company_tokens(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Distinct company and tenant names of a page in the order they first appear."""
    found = F.regexp_extract_all(or_empty(F.col("html")), F.lit(lex.COMPANY_TOKEN_PATTERN), 0)
    names = F.transform(
        found,
        lambda m: F.coalesce(
            filled(F.regexp_extract(m, lex.COMPANY_TOKEN_PATTERN, 1)),
            filled(F.regexp_extract(m, lex.COMPANY_TOKEN_PATTERN, 2)),
        ),
    )
    distinct = F.array_distinct(F.filter(names, lambda n: n.isNotNull()))
    return pages.select(page_id, F.posexplode(distinct).alias("pos", "token"))


def workday_candidates(
    sites: DataFrame, pages: DataFrame, discovered: DataFrame, site: str = "site"
) -> DataFrame:
    """Endpoint candidates per site, ordered by ``rank, seq, sub``.

    ``sites(site, url)``, ``pages(site, html)``, ``discovered(site, seq, url)``.
    """
    home = sites.select(site, F.col("url").alias("_home"))

    def both(candidate: Column) -> Column:
        full = (
            F.when(candidate.startswith("//"), F.concat(F.lit("https:"), candidate))
            .when(candidate.startswith("http"), candidate)
            .otherwise(absolutize_url(get_origin(F.col("_home")), candidate))
        )
        return let(
            F.rtrim(full, F.lit("/")),
            lambda plain: F.array(
                plain, F.when(plain.endswith("/jobs"), plain).otherwise(F.concat(plain, F.lit("/jobs")))
            ),
        )

    def endpoint(origin: Column, token: Column) -> Column:
        return F.array(F.concat(origin, F.lit("/wday/cxs/"), token, F.lit("/"), token, F.lit("/jobs")))

    seen = discovered.where(F.lower("url").contains("workday")).join(home, site)
    in_page = pages.select(
        site,
        F.posexplode(
            F.array_distinct(
                F.regexp_extract_all(or_empty(F.col("html")), F.lit(lex.WORKDAY_ENDPOINT_PATTERN), 0)
            )
        ).alias("_n", "_c"),
    ).join(home, site)
    first = F.try_element_at(path_segments(normalize_site_url(F.col("_home"))), F.lit(1))
    by_path = home.where(F.lower("_home").contains("workday") & first.isNotNull())
    by_token = company_tokens(pages, site).join(home, site)
    parts = [
        _candidates(seen, site, 1, F.col("seq"), both(F.col("url"))),
        _candidates(in_page, site, 2, F.col("_n"), both(F.col("_c"))),
        _candidates(by_path, site, 3, F.lit(0), endpoint(get_origin(F.col("_home")), first)),
        _candidates(by_token, site, 4, F.col("pos"), endpoint(get_origin(F.col("_home")), F.col("token"))),
    ]
    return ordered_distinct(_union(parts), "candidate", ["rank", "seq", "sub"], [site])


def json_candidates(
    sites: DataFrame,
    discovered: DataFrame,
    maximum: int = 8,
    site: str = "site",
    keywords: Sequence[str] = lex.ENDPOINT_KEYWORDS,
    common: Sequence[str] = lex.COMMON_JOB_PATHS,
) -> DataFrame:
    """Generic JSON endpoint candidates per site, the first ``maximum`` in order."""
    origin = get_origin(F.col("url"))
    path = F.rtrim(url_path(normalize_site_url(F.col("url"))), F.lit("/"))
    own = F.concat(origin, path)
    from_path = F.filter(
        F.array(own, F.concat(own, F.lit(".json"))), lambda c: any_contains(F.lower(c), keywords)
    )
    has_path = ~url_path(normalize_site_url(F.col("url"))).isin("", "/")
    parts = [
        _candidates(
            discovered.where(any_contains(F.lower("url"), keywords)),
            site, 1, F.col("seq"), F.array("url"),
        ),
        _candidates(sites.where(has_path), site, 2, F.lit(0), from_path),
        _candidates(
            sites, site, 3, F.lit(0), F.transform(lit_array(common), lambda p: F.concat(origin, p))
        ),
    ]
    order = ["rank", "seq", "sub"]
    firsts = ordered_distinct(_union(parts), "candidate", order, [site])
    return top_n_per(firsts, [site], order, maximum)


def discovered_urls(responses: DataFrame, requests: DataFrame, site: str = "site") -> DataFrame:
    """Distinct response and request URLs per site. It is a set: whoever shows it may sort it."""
    return responses.select(site, "url").unionByName(requests.select(site, "url")).distinct()
