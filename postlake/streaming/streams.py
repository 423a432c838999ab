"""Stream forms of the page scan, the job upsert, listing dedupe and seen windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlake.operators.dedupe import listing_key
from postlake.sources.io import add_compacted, snapshot_columns, upsert_into_jobs

#: Tasks that list the files of a batch. Spark's default is one a file up to 10,000, each with a result for the driver.
LISTING_TASKS = 64
#: Threads that move read files into the archive; Spark's default of one falls behind.
ARCHIVE_THREADS = 16


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one, but for how landed files are listed and archived.

    Such files are small and read many a task, so their block locations, most of a listing, serve nothing.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    tasks, threads = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.streaming.fileSource.cleaner.numThreads"
    own.conf.set(tasks, str(min(int(own.conf.get(tasks)), LISTING_TASKS)))
    own.conf.set(threads, str(max(int(own.conf.get(threads, "1")), ARCHIVE_THREADS)))
    own.conf.set("spark.sql.sources.ignoreDataLocality", "true")
    return own


def stream_pages(spark: SparkSession, root: str, max_files: int = 10_000, archive: str | None = None) -> DataFrame:
    """New page snapshots as a stream of `read_page_snapshots` rows, as `write_page_snapshots` lands them.

    With ``archive``, files move there once the batch after theirs is planned, and are not listed again.
    The stream runs in a session of its own, whose listing jobs have ``LISTING_TASKS`` tasks at most.
    """
    spark = _listing_session(spark)
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html")
        .option("maxFilesPerTrigger", max_files)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(root).select(*snapshot_columns(F.col("_metadata.file_path"), F.col("value")))


def compact_pages(
    spark: SparkSession, landed: str, store: str, checkpoint: str, archive: str, max_files: int = 10_000
) -> StreamingQuery:
    """Add all pages that have landed since the last call to a Parquet store by capture day, then stop.

    Land one folder per period (an hour, a day) and give each its own checkpoint. Listing a folder
    costs what has landed there and is not archived yet, and the stream's log names the files of one
    period; when a period is over, its checkpoint and archive can go, and nothing grows with all pages
    ever landed. A batch is the part ``period-batch`` of the store: replayed, it replaces itself.
    """
    period = landed.rstrip("/").rsplit("/", 1)[-1]

    def apply(batch: DataFrame, batch_id: int) -> None:
        add_compacted(batch, store, f"{period}-{batch_id}")

    return (
        stream_pages(spark, landed, max_files, archive)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert(stream: DataFrame, root: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Apply all that is available to the job table, then stop.

    The checkpoint orders the batches; the last one may be replayed after a failure, which changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_into_jobs(batch, root, order)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(
    stream: DataFrame, ts: str, delay: str, within: tuple[str, ...] = (), key: Column | None = None
) -> DataFrame:
    """First arrival per listing key; state is dropped once the watermark passes ``delay``.

    A stream keeps the row that arrives first, not the first by position.
    """
    keyed = stream.withColumn("_key", listing_key(lower=True) if key is None else key)
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*within, "_key"]).drop("_key")


def posting_lifetime(snapshots: DataFrame, site: str = "site", url: str = "url", ts: str = "captured_at") -> DataFrame:
    """First and last sighting per posting, and whether the site's newest run still has it."""
    seen = snapshots.groupBy(site, url).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    newest = seen.groupBy(site).agg(F.max("last_seen").alias("_newest"))
    return seen.join(newest, site).select(
        site, url, "first_seen", "last_seen", (F.col("last_seen") == F.col("_newest")).alias("is_active")
    )


def stream_lifetime(
    snapshots: DataFrame,
    period: timedelta,
    delay: str = "0 seconds",
    site: str = "site",
    url: str = "url",
    ts: str = "captured_at",
) -> DataFrame:
    """Sightings of postings as they arrive: site, url, first_seen, last_seen, is_active.

    A posting that is seen is given out as active. When time has passed ``period``, the longest time
    between two runs, without it, it is given out once as inactive and its state is dropped; a later
    sighting starts anew. State is two times per active posting, so no site gathers in one task.
    `lifetimes` folds what was given out. Spark leaves out rows that come more than ``delay`` behind the
    newest one of the batches before, so it must cover the longest lateness. Rows without site, URL or
    time are left out.
    """
    step = period // timedelta(microseconds=1)
    fields = ["site", "url", "first", "last", "active"]

    def seen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *known, False)], columns=fields)
            return
        times = [t for part in parts for t in (part["at"].min(), part["at"].max())]
        first, last = (int(f([*times, *(known or ())])) for f in (min, max))
        until = (last + step) // 1000 - 1
        active = until > state.getCurrentWatermarkMs()
        if active:
            state.update((first, last))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, first, last, active)], columns=fields)

    rows = snapshots.select(
        F.col(site).alias("site"), F.col(url).alias("url"), F.col(ts).cast("timestamp").alias("time")
    ).dropna()
    kinds = rows.schema
    given = (
        rows.withWatermark("time", delay)
        .withColumn("at", F.unix_micros("time"))
        .groupBy("site", "url")
        .applyInPandasWithState(
            seen,
            f"site {kinds['site'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, first long, last long, active boolean",
            "first long, last long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return given.select(
        F.col("site").alias(site), F.col("url").alias(url), F.timestamp_micros("first").alias("first_seen"),
        F.timestamp_micros("last").alias("last_seen"), F.col("active").alias("is_active"),
    )


def lifetimes(given: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """First and last sighting of each posting and whether it is active, from what `stream_lifetime` gave out."""
    return given.groupBy(site, url).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("is_active", F.struct("last_seen", ~F.col("is_active"))).alias("is_active"),
    )
