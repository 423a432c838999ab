from pyspark.sql import functions as F

from postlake.operators.merge import upsert_jobs
from postlake.sources import io
from postlake.streaming import streams as st

BATCH = "seq long, site_id long, title string, location string, url string, raw_json string"


def test_page_stream_equals_the_batch_read(spark, tmp_path):
    folder = tmp_path / "in" / "h.com"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"J{i}_20260406_11244{i}.html").write_text(f"<p>{i}</p>")
    out = str(tmp_path / "out")
    pages = st.stream_pages(spark, str(tmp_path / "in"), max_files=1)
    (
        pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    assert sorted(spark.read.parquet(out).collect()) == sorted(io.read_page_snapshots(spark, str(tmp_path / "in")).collect())


def batches(spark, folder):
    rows = [
        [(1, 1, "a", "l", "u1", "{}"), (2, 1, "b", "l", "u2", "{}")],
        [(3, 1, "c", "l", "u1", "{}"), (4, 2, "d", "l", "u1", "{}"), (5, 2, " ", "l", "u9", "{}")],
    ]
    for part in rows:
        spark.createDataFrame(part, BATCH).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_upsert_equals_the_batch_upsert(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"))
    root = str(tmp_path / "db")
    st.stream_upsert(stream, root, str(tmp_path / "c")).awaitTermination()
    got = io.read_jobs(spark, root)
    all_rows = spark.read.schema(BATCH).parquet(str(tmp_path / "in"))
    want = upsert_jobs(spark.createDataFrame([], io.JOBS_SCHEMA), all_rows)
    key = ("site_id", "url", "title")
    assert sorted(tuple(r[c] for c in key) for r in got.collect()) == sorted(tuple(r[c] for c in key) for r in want.collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    batch = spark.createDataFrame([(1, 1, "a", "l", "u1", "{}")], BATCH)
    io.upsert_into_jobs(batch, root)
    before = io.read_jobs(spark, root).collect()
    io.upsert_into_jobs(batch, root)
    assert io.read_jobs(spark, root).collect() == before


def page_rows(spark, names):
    at = F.to_timestamp(F.lit("2026-04-06 11:24:46"))
    return spark.createDataFrame([("h.com", n, f"<p>{n}") for n in names], "domain string, job_id string, html string").withColumn("captured_at", at)


def test_compaction_archives_what_it_has_read(spark, tmp_path):
    landed, store, mark, kept = (str(tmp_path / n) for n in ("p1", "store", "c", "kept"))

    def compact(names):
        io.write_page_snapshots(page_rows(spark, names), landed)
        st.compact_pages(spark, landed, store, mark, kept, max_files=2).awaitTermination()
        return {r.job_id for r in io.read_compacted(spark, store).collect()}

    first = ["_a", "b", "c", "d", "e"]
    assert compact(first) == set(first)
    # The files of all batches but the last are gone from the folder, so they are not listed again.
    assert len(list((tmp_path / "p1").rglob("*.html"))) == 1 and len(list((tmp_path / "kept").rglob("*.html"))) == 4
    assert compact(["f"]) == {*first, "f"}
    assert io.read_compacted(spark, store).count() == 6
    assert len(list((tmp_path / "p1").rglob("*.html"))) == 1
    assert io.read_page_snapshots(spark, landed).count() == 1
    assert {str(r.day) for r in io.read_compacted(spark, store).collect()} == {"2026-04-06"}


def test_a_compacted_part_replaces_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    odd = page_rows(spark, ["x"]).withColumn("captured_at", F.lit(None).cast("timestamp"))
    for rows, part in ((page_rows(spark, ["a", "b"]), "p-0"), (page_rows(spark, ["a", "b"]), "p-0"), (odd, "p-1"), (page_rows(spark, ["c"]), "q-0")):
        io.add_compacted(rows, store, part)
    got = sorted((r.job_id, r.day) for r in io.read_compacted(spark, store).collect())
    assert got == [("a", "2026-04-06"), ("b", "2026-04-06"), ("c", "2026-04-06"), ("x", "unknown")]


def test_stream_dedupe_keeps_one_row_per_key(spark, tmp_path):
    rows = [("s", "U1", "A", "P", "2026-01-01 00:00:00"), ("s", "u1", "B", "P", "2026-01-01 00:01:00"), ("s", "", "C", "P", "2026-01-01 00:02:00"), ("t", "u1", "D", "P", "2026-01-01 00:03:00")]
    df = spark.createDataFrame(rows, "site string, url string, title string, location string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    unique = st.stream_dedupe(stream, "at", "1 hour", ("site",))
    unique.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.site, r.url.lower()) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("s", ""), ("s", "u1"), ("t", "u1")]


def test_posting_lifetime(spark):
    rows = [("s", "u1", 1), ("s", "u1", 2), ("s", "u2", 1), ("t", "u3", 1)]
    out = st.posting_lifetime(spark.createDataFrame(rows, "site string, url string, captured_at int"))
    assert sorted((r.url, r.first_seen, r.last_seen, r.is_active) for r in out.collect()) == [
        ("u1", 1, 2, True), ("u2", 1, 1, False), ("u3", 1, 1, True),
    ]


def test_a_stream_onto_a_written_table_and_a_new_checkpoint_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = [(v + 1, 9, f"t{v}", "l", f"w{v}", "{}") for v in range(3)]
    io.create_jobs(spark.createDataFrame(rows, io.JOBS_SCHEMA), root)
    for name in ("first", "second"):
        for n in range(2):
            row = [(n, 1, "a", "l", f"{name}{n}", "{}")]
            spark.createDataFrame(row, BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        st.stream_upsert(stream, root, str(tmp_path / f"c-{name}")).awaitTermination()
    got = io.read_jobs(spark, root).collect()
    assert {r.url for r in got} == {"w0", "w1", "w2", "first0", "first1", "second0", "second1"}
    assert len({r.id for r in got}) == 7


def test_stream_reads_ids_that_start_with_an_underscore(spark, tmp_path):
    at = F.to_timestamp(F.lit("2026-04-06 11:24:46"))
    rows = spark.createDataFrame([("h.com", "_R1", "x"), ("h.com", ".R2", "y"), ("h.com", "=R3", "z"), ("h.com", "J", "w")], "domain string, job_id string, html string")
    io.write_page_snapshots(rows.withColumn("captured_at", at), str(tmp_path / "in"))
    pages = st.stream_pages(spark, str(tmp_path / "in"))
    pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"_R1", ".R2", "=R3", "J"}


def replay(spark, tmp_path, days, name):
    """Days of (site, url) sightings, each landed and taken; rows that were given out, and the state left after each."""
    from datetime import datetime, timedelta

    schema, states = "site string, url string, captured_at timestamp", []
    for i, seen in enumerate(days):
        rows = [(s, u, datetime(2026, 1, 1) + timedelta(days=i)) for s, u in seen]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        given = st.stream_lifetime(spark.readStream.schema(schema).parquet(str(tmp_path / name)), timedelta(days=1))
        out = given.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out"))
        query = out.option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / f"{name}-out")), states


def test_lifetimes_of_a_replayed_stream(spark, tmp_path):
    days = [[("s", "a"), ("s", "b"), ("t", "a")], [("s", "a"), ("s", "a"), (None, "x"), ("s", None)], [("s", "a"), ("s", "c"), ("t", "a")], [("s", "c")]]
    given, states = replay(spark, tmp_path, days, "runs")
    got = {(r.site, r.url): (r.first_seen.day, r.last_seen.day, r.is_active) for r in st.lifetimes(given).collect()}
    assert got == {("s", "a"): (1, 3, False), ("s", "b"): (1, 1, False), ("s", "c"): (3, 4, True), ("t", "a"): (1, 3, False)}
    # A posting that a run passed without is given out once as inactive, and nothing is kept of it.
    assert given.where("url = 'b' AND NOT is_active").count() == 1
    assert given.where("site = 't' AND NOT is_active").count() == 2
    assert states[-1] == 1


def test_lifetimes_of_no_rows(spark, tmp_path):
    given = spark.createDataFrame([], "site string, url string, first_seen timestamp, last_seen timestamp, is_active boolean")
    assert st.lifetimes(given).collect() == []


def test_a_batch_is_listed_by_few_tasks(spark, tmp_path):
    """A listing task per file would send the driver a result per file."""
    io.write_page_snapshots(page_rows(spark, [f"J{i}" for i in range(150)]).repartition(4), str(tmp_path / "in"))
    pages = st.stream_pages(spark, str(tmp_path / "in")).drop("html")
    query = (
        pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    sizes = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]
    assert sizes and max(sizes) <= st.LISTING_TASKS
    assert spark.read.parquet(str(tmp_path / "out")).select("job_id").distinct().count() == 150
    assert spark.conf.get("spark.sql.sources.ignoreDataLocality") == "false"  # the caller's session is as it was
