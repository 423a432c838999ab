"""runs applied to the site table one after another, without a sequential pass.

A run found its site under ``url`` and ended at ``final_url``. In order of ``seq``:

- the site that is called ``url`` at that time moves to ``final_url``; if another site is called so
  then, the run is refused, as both are known and domains are unique;
- else the site called ``final_url`` is updated;
- else a new site is added.

So a run may continue what an earlier one of the batch did (``n -> m``, then ``m -> m2``). Each run
touches two names. A name is taken after a run ended there, and free after a run moved its site away, so
what a run finds follows from the run before it at that name, which one window gives. Whose site it is
is found by following these links backwards, doubled until all have reached a known site or the run
that added it: the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.merge import assign_ids
from postlake.session import stored

#: Spans of ``seq`` in which the runs of one name are ordered apart, so that a hot name is not one task.
SPANS = 256

# A run at a name is one number, twice the run and its role there: what is shuffled in each round stays small.
_GIVEN, _FINAL = 0, 1


def _run(node: Column) -> Column:
    return F.shiftright(node, 1)


def _role(node: Column) -> Column:
    return node.bitwiseAND(F.lit(1).cast("long"))


def _node(run: Column, role: int | Column) -> Column:
    return run * 2 + (F.lit(role) if isinstance(role, int) else role)


def _runs(runs: DataFrame) -> DataFrame:
    """Runs numbered in order of ``seq``, then of a hash of their values; equal rows are one run.

    Those without a URL can't be placed. The numbers hold for what is stored of them.
    """
    fields = ["seq", "url", "final_url", "type", "confidence"]
    named = runs.select(*fields).where(F.col("url").isNotNull() & F.col("final_url").isNotNull())
    hashed = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)), 1, 16)
    distinct = named.withColumn("_tie", hashed).dropDuplicates(["_tie"])
    ordered = distinct.withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long")).orderBy("seq", "_tie")
    return ordered.drop("_tie").withColumn("run", F.monotonically_increasing_id())


def _touched(runs: DataFrame) -> DataFrame:
    """A row per run and name it touches: its node, the name, and the node before it at that name."""
    name = lambda role, column: F.struct(F.lit(role).alias("role"), F.col(column).alias("name"))
    both = F.array(name(_GIVEN, "url"), name(_FINAL, "final_url"))
    roles = F.when(F.col("url") == F.col("final_url"), F.slice(both, 2, 1)).otherwise(both)
    rows = runs.select("run", "seq", F.explode(roles).alias("t"))
    low, high = runs.agg(F.min("seq"), F.max("seq")).first()
    width = ((high - low) // SPANS + 1) if low is not None else 1
    span = F.floor((F.col("seq") - F.lit(low or 0)) / width).cast("int")
    rows = rows.select(_node(F.col("run"), F.col("t.role")).alias("node"), F.col("t.name").alias("name"), span.alias("span"))
    inside = Window.partitionBy("name", "span").orderBy("node")
    ends = rows.groupBy("name", "span").agg(F.max("node").alias("last"))
    ends = ends.withColumn("ahead", F.lag("last").over(Window.partitionBy("name").orderBy("span"))).drop("last")
    linked = rows.withColumn("before", F.lag("node").over(inside)).join(ends, ["name", "span"])
    return linked.select("node", "name", F.coalesce("before", "ahead").alias("before"))


def _rounds(rows: DataFrame, open_rows: Column, again: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """Rows after rounds of ``again(open rows, all rows)`` until none is open. A round stores what it changed only."""
    rows = stored(rows, name)
    done, left = [rows.where(~open_rows)], rows.where(open_rows)
    while left.limit(1).count():
        changed = stored(again(left, reduce(DataFrame.unionByName, [*done, left])), name)
        done.append(changed.where(~open_rows))
        left = changed.where(open_rows)
    return reduce(DataFrame.unionByName, done)


def _refusals(touched: DataFrame) -> DataFrame:
    """Whether each run was refused: both of its names were taken, by different sites.

    A name's state is known, or it is what the run before it there left: taken if that one was refused.
    So a run waits for up to two others (``waits``). A round replaces a run it waits for by what that
    is known to be, or, if that one waits for a single run, by that single run.
    """
    before = F.col("before")
    state = F.when(before.isNull(), F.col("known").isNotNull()).when(_role(before) == _FINAL, F.lit(True))
    rows = touched.select(_run(F.col("node")).alias("run"), state.alias("state"), F.when(state.isNull(), _run(before)).alias("wait"))
    judged = (
        rows.groupBy("run")
        .agg(
            (F.count("*") < 2).alias("single"),
            F.bool_or(~F.col("state")).alias("free"),
            F.collect_set("wait").alias("waits"),  # two at most
        )
        .withColumn(
            "refused",
            F.when(F.col("single") | F.coalesce("free", F.lit(False)), F.lit(False)).when(F.size("waits") == 0, F.lit(True)),
        )
        .select("run", "refused", F.when(F.col("refused").isNull(), F.col("waits")).alias("waits"))
    )

    def again(left: DataFrame, judged: DataFrame) -> DataFrame:
        known = judged.select(F.col("run").alias("wait"), F.col("refused").alias("r"), F.col("waits").alias("w"))
        waiting = left.select("run", F.explode("waits").alias("wait"))
        next_wait = F.when(F.col("r").isNull(), F.when(F.size("w") == 1, F.col("w")[0]).otherwise(F.col("wait")))
        return (
            waiting.join(known, "wait")
            .groupBy("run")
            .agg(F.bool_or(~F.col("r")).alias("free"), F.collect_set(next_wait).alias("waits"))
            .select(
                "run",
                F.when(F.coalesce("free", F.lit(False)), F.lit(False)).when(F.size("waits") == 0, F.lit(True)).alias("refused"),
                "waits",
            )
        )

    return _rounds(judged, F.col("refused").isNull(), again, "refusals").select("run", "refused")


def _followed(links: DataFrame) -> DataFrame:
    """Site of each node: links (node, to, id, added_by) doubled until none leads on. Each node is led to by one other."""

    def again(left: DataFrame, links: DataFrame) -> DataFrame:
        ahead = links.select(F.col("node").alias("to"), F.col("to").alias("on"), "id", "added_by")
        return left.select("node", "to").join(ahead, "to", "left").select("node", F.col("on").alias("to"), "id", "added_by")

    return _rounds(links, F.col("to").isNotNull(), again, "links").drop("to")


def resolve_runs(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """What each run did: seq, url, final_url, type, confidence, outcome, id, added_by.

    ``outcome`` is moved, updated, added or refused. ``id`` is the known site's, ``added_by`` names
    the run that added the site; both are null for a refused run. Runs of equal ``seq`` go in a fixed order of
    their values, equal rows are one run, a null ``seq`` counts as 0; runs without a URL are left out.
    """
    runs = stored(_runs(runs), "runs")
    known = sites.select(F.col("domain").alias("name"), F.col("id").alias("known")).where(F.col("name").isNotNull())
    touched = _touched(runs)
    first = touched.where(F.col("before").isNull()).join(known, "name", "left").drop("name")
    later = touched.where(F.col("before").isNotNull()).drop("name").withColumn("known", F.lit(None).cast("long"))
    touched = stored(first.unionByName(later), "touched")
    refused = _refusals(touched)
    before = F.col("before")

    # What the run before it left: a name is free after a site moved away, else taken.
    left = refused.select(F.col("run").alias("b_run"), F.col("refused").alias("b_refused"))
    seen = touched.withColumn("b_run", _run(before)).join(left, "b_run", "left").select(
        _run(F.col("node")).alias("run"),
        _role(F.col("node")).alias("role"),
        F.when(before.isNull(), F.col("known").isNotNull())
        .when(_role(before) == _FINAL, F.lit(True))
        .otherwise(F.col("b_refused"))
        .alias("taken"),
    )
    found = seen.groupBy("run").agg(
        F.coalesce(F.bool_or(F.when(F.col("role") == _GIVEN, F.col("taken"))), F.lit(False)).alias("given"),
        F.coalesce(F.bool_or(F.when(F.col("role") == _FINAL, F.col("taken"))), F.lit(False)).alias("final"),
    )
    outcome = (
        F.when(F.col("refused"), F.lit("refused"))
        .when(F.col("given"), F.lit("moved"))
        .when(F.col("final"), F.lit("updated"))
        .otherwise(F.lit("added"))
    )
    judged = stored(found.join(refused, "run").select("run", outcome.alias("outcome")), "outcomes")

    # A name's site is the one that the run before it left there.
    led = judged.select(F.col("run").alias("b_run"), F.col("outcome").alias("b_outcome"))
    moved = (_role(before) == _FINAL) & (F.col("b_outcome") == "moved")
    added = (_role(before) == _FINAL) & (F.col("b_outcome") == "added")
    stays = (_role(before) == _FINAL) | (F.col("b_outcome") == "refused")
    links = touched.withColumn("b_run", _run(before)).join(led, "b_run", "left").select(
        "node",
        F.when(added, F.lit(None)).when(moved, _node(F.col("b_run"), _GIVEN)).when(stays, before).alias("to"),
        F.col("known").alias("id"),
        F.when(added, F.col("b_run")).alias("added_by"),
    )
    role = F.when(F.col("outcome") == "moved", F.lit(_GIVEN)).when(F.col("outcome") == "updated", F.lit(_FINAL))
    owned = judged.withColumn("node", _node(F.col("run"), role)).join(_followed(links), "node", "left")
    own = F.when(F.col("outcome") == "added", F.col("run")).otherwise(F.col("added_by"))
    return runs.join(owned.select("run", "outcome", "id", own.alias("added_by")), "run")


def refused_runs(resolved: DataFrame) -> DataFrame:
    """Runs that would have given two sites one domain. They changed nothing."""
    return resolved.where("outcome = 'refused'").select("seq", "url", "final_url", "type", "confidence")


def upsert_sites(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """New version of the site table after ``runs(url, final_url, type, confidence, seq)``, see above.

    No site goes, so every job still finds its own; see `refused_runs` for what could not be applied.
    """
    return applied(sites, resolve_runs(sites, runs))


def applied(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """The site table after resolved runs: the last run of a site tells its domain, type and confidence."""
    values = ("domain", "type", "confidence")
    value = F.struct(F.col("final_url").alias("domain"), "type", "confidence")
    done = resolved.where("outcome <> 'refused'").groupBy("id", "added_by")
    last = done.agg(F.max_by(value, "run").alias("_new"))
    updates = last.where(F.col("id").isNotNull()).select("id", "_new")
    pick: Callable[[str], Column] = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    known = sites.join(updates, "id", "left").select("id", *[pick(c).alias(c) for c in values])
    inserts = last.where(F.col("id").isNull()).select("_new.*")
    return known.unionByName(assign_ids(inserts, sites, ["domain"]).select("id", *values))
