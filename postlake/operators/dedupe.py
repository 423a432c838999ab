"""First-wins, latest and top-N rows, and the stop rule for paged captures.

Rankings filter on ``row_number`` so that Spark keeps at most n rows per key in every map
task before the shuffle: a key holding a third of the input moves n rows per task, not all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _ranked(df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def dedupe_first(
    df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName]
) -> DataFrame:
    """First row per key; ``order`` must end in a unique column."""
    return _ranked(df, keys, order, 1)


def listing_key(url: str = "url", title: str = "title", location: str = "location", lower: bool = False) -> Column:
    """URL, or title and location when there is no URL."""
    key = F.coalesce(
        F.nullif(F.col(url), F.lit("")),
        F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(location, F.lit(""))),
    )
    return F.lower(key) if lower else key


def dedupe_listings(
    df: DataFrame, order: Sequence[ColumnOrName], within: Sequence[str] = (), lower: bool = False
) -> DataFrame:
    """`dedupe_first` on the listing key, inside the columns ``within``."""
    keyed = df.withColumn("_key", listing_key(lower=lower))
    return dedupe_first(keyed, [*within, "_key"], order).drop("_key")


def ordered_distinct(
    df: DataFrame, value: str, order: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Distinct values with the order of their first appearance."""
    return df.groupBy(*within, value).agg(F.min(F.struct(*order)).alias("_first")).select(
        *within, value, "_first.*"
    )


def top_n_per(
    df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName], n: int = 5
) -> DataFrame:
    return _ranked(df, keys, order, n)


def latest_per(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """All rows of the newest snapshot of every key.

    The newest time comes from a map-side combined maximum; only (key, time) is shuffled
    for it. The join back is a plain equi join, which AQE splits when a key is hot.
    """
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(newest, [*keys, ts], "left_semi")


def drop_duplicate_urls(df: DataFrame, url: str, order: Sequence[ColumnOrName]) -> DataFrame:
    """First row per URL; rows without a URL count as one value."""
    return dedupe_first(df, [url], order)


def stop_on_no_growth(
    df: DataFrame,
    group: str,
    page: str,
    key: str,
    order: Sequence[str],
    patience: int = 1,
    min_page: int = 0,
    max_pages: int | None = None,
    first_page: int = 0,
) -> DataFrame:
    """One row per key, from the pages read before paging would have stopped.

    Paging stops after ``patience`` pages in a row, from ``min_page`` on, that bring no new
    key. A page absent from the capture counts as one without new keys.

    No ordered scan of a group is needed. A page with new keys keeps the ``patience`` pages
    after it reachable; the first page with new keys that nothing keeps reachable is where
    paging had already stopped. Both steps are map-side combined aggregates.
    """
    inside = df.where(F.col(page) < first_page + max_pages) if max_pages else df
    firsts = dedupe_first(inside, [group, key], [page, *order])
    reach = (
        firsts.select(group, page)
        .distinct()
        .select(group, page, F.explode(F.sequence(F.lit(0), F.lit(patience))).alias("_step"))
        .withColumn(page, F.col(page) + F.col("_step"))
    )
    marks = reach.groupBy(group, page).agg(
        F.max(F.col("_step") == 0).alias("_grew"), F.max(F.col("_step") > 0).alias("_reached")
    )
    start = max(first_page, min_page)
    cut = marks.where(F.col("_grew") & ~F.col("_reached") & (F.col(page) >= start + patience))
    stop = cut.groupBy(group).agg(F.min(page).alias("_stop"))
    return (
        firsts.join(stop, group, "left")
        .where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
        .drop("_stop")
    )
