"""The same computations for archives whose scans and events keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.operators import diff
from keepsake.operators.running import Running, running
from keepsake.session import stage
from keepsake.sources.tables import TableSet, latest_rows, upsert

SCAN_KEY = ("archive_id", "project")


def run_available(query: StreamingQuery, seconds: int = 3600) -> None:
    """Wait for an ``availableNow`` query and raise what it raised."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not finish")


def _per_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- scans -----------------------------------------------------------------------------------


def apply_scans(
    announced: DataFrame,
    snapshots: DataFrame,
    sealed: DataFrame,
    store: TableSet,
    now: Column,
    now_ns: int,
    settle_hours: float,
) -> None:
    """Diff, classify and plan the newest announced scan of each archive; publish the new state.

    ``announced`` has ``archive_id, scan_id``: a scan is announced when its snapshot is complete.
    ``snapshots`` holds all of them, partitioned by archive and scan. A scan not newer than the
    last one applied changes nothing, so neither a replayed batch nor a late scan does.
    """
    applied = store.read("applied_scans")
    asked = announced.select("archive_id", "scan_id").distinct()
    if applied is None:
        applied = asked.limit(0).withColumn("applied_at", now)
    last = applied.groupBy("archive_id").agg(F.max("scan_id").alias("last_scan"))
    fresh = (
        asked.join(last, "archive_id", "left")
        .where(F.col("last_scan").isNull() | (F.col("scan_id") > F.col("last_scan")))
        .select("archive_id", "scan_id")
    )
    if fresh.isEmpty():
        return
    newest = fresh.groupBy("archive_id").agg(F.max("scan_id").alias("newest"))
    both = (
        fresh.unionByName(applied.select("archive_id", "scan_id"))
        .join(newest, "archive_id")
        .groupBy("archive_id", "newest")
        .agg(F.max(F.when(F.col("scan_id") < F.col("newest"), F.col("scan_id"))).alias("earlier"))
    )
    scans = stage(both)  # one row per archive
    low = F.coalesce("earlier", "newest")
    span = scans.agg(
        F.min(low), F.max("newest"), F.min("archive_id"), F.max("archive_id")
    ).first()
    # Constants prune the snapshot partitions; a join alone would list every scan ever landed.
    snapshots = snapshots.where(
        F.col("scan_id").between(span[0], span[1])
        & F.col("archive_id").between(span[2], span[3])
    )
    current = snapshots.join(
        scans.select("archive_id", F.col("newest").alias("scan_id")),
        ["archive_id", "scan_id"],
        "left_semi",
    )
    previous = snapshots.join(
        scans.select("archive_id", F.col("earlier").alias("scan_id")),
        ["archive_id", "scan_id"],
        "left_semi",
    )
    readable = current.where(F.col("error").isNull())
    record = sealed.join(scans.select("archive_id"), "archive_id", "left_semi")
    summary = stage(
        diff.settled(
            diff.diff_summary(readable, record, previous, SCAN_KEY), now_ns, settle_hours
        )
    )
    rows = diff.diff_against_sealed(readable, record, SCAN_KEY)
    broken = diff.scan_health(current, SCAN_KEY).select(
        *SCAN_KEY, F.col("error").alias("scan_error")
    )
    known = store.read("projects")
    first_scan = [*SCAN_KEY, "state", "preexisting", "review_reason", "last_generation_no"]
    seen = summary.where(F.col("files") > 0)
    recorded = F.col("unchanged") + F.col("modified") + F.col("deleted") > 0
    if known is None:
        known = seen.limit(0).select(
            *SCAN_KEY,
            F.lit("").alias("state"),
            F.lit(True).alias("preexisting"),
            F.lit("").alias("review_reason"),
            F.lit(1).alias("last_generation_no"),
        )
    archives = known.select("archive_id").distinct().withColumn("__known", F.lit(True))
    new = (
        seen.join(known.select(*SCAN_KEY), list(SCAN_KEY), "left_anti")
        .join(archives, "archive_id", "left")
        .select(
            *SCAN_KEY,
            F.lit("unsealed").alias("state"),
            F.col("__known").isNull().alias("preexisting"),
            F.lit(None).cast("string").alias("review_reason"),
            F.when(recorded, 1).alias("last_generation_no"),
        )
    )
    projects = known.select(*first_scan).unionByName(new)
    decided = diff.classify(projects, summary, diff.review_reason(rows, SCAN_KEY), SCAN_KEY)
    listed = seen.select(*SCAN_KEY, F.lit(True).alias("__listed"), "settled")
    decided = decided.join(listed, list(SCAN_KEY), "left").join(broken, list(SCAN_KEY), "left")
    touched = scans.select("archive_id").withColumn("__scanned", F.lit(True))
    decided = decided.join(touched, "archive_id", "left")
    state = (
        F.when(F.col("__scanned").isNull() | (F.col("state") == "ignored"), F.col("state"))
        .when(F.col("scan_error").isNotNull(), "error")
        .when(F.col("__listed").isNull(), "missing")
        .otherwise(F.col("new_state"))
    )
    planned = diff.auto_work(
        decided.withColumn("state", state).withColumn(
            "settled", F.coalesce("settled", F.lit(False))
        )
    )
    planned = stage(
        planned.select(*first_scan, "new_reason", "work")
    )
    result = planned.select(
        *SCAN_KEY,
        F.when(F.col("work").isNotNull(), "queued").otherwise(F.col("state")).alias("state"),
        "preexisting",
        F.when(F.col("state") == "needs_review", F.col("new_reason")).alias("review_reason"),
        "last_generation_no",
    )
    work = planned.where(F.col("work").isNotNull()).select(
        *SCAN_KEY, F.col("work").alias("kind"), now.alias("created_at")
    )
    log = applied.unionByName(fresh.withColumn("applied_at", now))
    store.publish({"projects": result, "work": work, "applied_scans": log})


def scan_stream(
    announcements: DataFrame,
    snapshots: Callable[[], DataFrame],
    sealed: DataFrame,
    store: TableSet,
    checkpoint: str,
    now: Column,
    now_ns: int,
    settle_hours: float,
) -> StreamingQuery:
    """Apply scans as they are announced. ``snapshots`` reads the landed snapshots afresh."""

    def work(batch: DataFrame, _: int) -> None:
        apply_scans(batch, snapshots(), sealed, store, now, now_ns, settle_hours)

    return _per_batch(announcements, work, checkpoint)


# --- state changes ---------------------------------------------------------------------------


def state_changes(
    events: DataFrame, by: Sequence[str], order: Sequence[str], last: DataFrame | None = None
) -> DataFrame:
    """Rows whose ``state`` differs from the one before it of the same project.

    ``last`` has the last state seen before these events. A project with any number of events is
    spread over tasks.
    """
    rows = running(
        events,
        by,
        order,
        __before=Running("max", F.struct(*[c.lstrip("-") for c in order], "state"), "before"),
    ).withColumn("old_state", F.col("__before.state"))
    if last is not None:
        seen = last.select(*by, F.col("state").alias("__last"))
        rows = rows.join(seen, list(by), "left").withColumn(
            "old_state", F.coalesce("old_state", "__last")
        )
    changed = ~F.col("state").eqNullSafe(F.col("old_state"))
    return rows.where(changed).select(*events.columns, "old_state")


def state_change_stream(
    events: DataFrame,
    store: TableSet,
    out: str,
    checkpoint: str,
    by: Sequence[str],
    order: Sequence[str],
) -> StreamingQuery:
    """Append the state changes of each batch to ``out`` and keep the last state per project.

    A batch writes its own folder and publishes the last states under its number, so running it
    again gives the same folder from the same earlier states.
    """

    def work(batch: DataFrame, number: int) -> None:
        known = store.read("last_states")
        if known is not None:
            done = store.read("batch").first()["number"]
            if number <= done:
                return
        batch = batch.persist()
        try:
            changes = state_changes(batch, by, order, known)
            changes.write.mode("overwrite").parquet(f"{out}/batch={number}")
            newest = latest_rows(
                batch.select(*by, *[c.lstrip("-") for c in order], "state"),
                by,
                [c.lstrip("-") for c in order],
            ).select(*by, "state")
            merged = newest if known is None else upsert(known, newest, by)
            mark = batch.sparkSession.createDataFrame([(number,)], "number bigint")
            store.publish({"last_states": merged, "batch": mark})
        finally:
            batch.unpersist()

    return _per_batch(events, work, checkpoint)


# --- quiescence ------------------------------------------------------------------------------


def quiet_periods(
    events: DataFrame, by: Sequence[str], time: str, tie: str, gap_seconds: int
) -> DataFrame:
    """Runs of changes closer than the gap: ``started_at, last_change_at, changes`` (batch)."""
    order = [time, tie]
    stepped = running(
        events.select(*by, *order), by, order, __previous=Running("max", F.col(time), "before")
    )
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    opens = F.col("__previous").isNull() | (F.col(time) >= F.col("__previous") + gap)
    numbered = running(
        stepped.withColumn("__opens", opens.cast("int")),
        by,
        order,
        __run=Running("sum", F.col("__opens")),
    )
    return (
        numbered.groupBy(*by, "__run")
        .agg(
            F.min(time).alias("started_at"),
            F.max(time).alias("last_change_at"),
            F.count(F.lit(1)).alias("changes"),
        )
        .drop("__run")
    )


def with_clock(events: DataFrame, clock: DataFrame | None, time: str) -> DataFrame:
    """``events`` with the instants of ``clock`` (a stream with a ``time`` column) marked
    ``__tick``; without a clock no row is marked.

    The watermark follows the newest instant of either, so what waits for quiet comes out although
    nothing more happens. A tick has to land after the events before it.
    """
    marked = events.withColumn("__tick", F.lit(False))
    if clock is None:
        return marked
    ticks = clock.select(time, F.lit(True).alias("__tick"))
    return marked.unionByName(ticks, allowMissingColumns=True)


def quiescence(
    events: DataFrame,
    by: Sequence[str],
    time: str,
    gap: str,
    delay: str,
    clock: DataFrame | None = None,
) -> DataFrame:
    """The early signal: a project's run of changes once it has been quiet for ``gap`` (stream).

    The last run of each project comes out when ``clock`` passes its end (see :func:`with_clock`).
    """
    events.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
    )
    real = ~F.col("__tick")
    return (
        with_clock(events.select(*by, time), clock, time)
        .withWatermark(time, delay)
        .groupBy(*by, F.session_window(time, gap).alias("run"))
        .agg(F.count_if(real).alias("changes"), F.max(F.when(real, F.col(time))).alias("last_change_at"))
        .where(F.col("changes") > 0)
        .select(*by, F.col("run.start").alias("started_at"), "last_change_at",
                F.col("run.end").alias("settled_at"), "changes")
    )


# --- progress and log ------------------------------------------------------------------------


def progress_rollup(
    progress: DataFrame,
    by: Sequence[str],
    time: str,
    delay: str,
    every: str = "500 milliseconds",
    clock: DataFrame | None = None,
) -> DataFrame:
    """At most one progress row per item and interval, and always its first and last.

    ``progress`` has ``files_done, files_total``. Per window: the latest row in between, a row
    with nothing done, and a row with all done. The last rows come out when ``clock`` passes them
    (see :func:`with_clock`).
    """
    done, total = F.col("files_done"), F.col("files_total")
    kind = F.when(done == 0, "first").when(done == total, "last").otherwise("between")
    row = F.struct(F.col(time), done, total)
    windowed = (
        with_clock(progress, clock, time)
        .withColumn("__kind", F.when(~F.col("__tick"), kind))
        .withWatermark(time, delay)
        .groupBy(*by, F.window(time, every).alias("__window"))
        .agg(
            *[
                F.max(F.when(F.col("__kind") == k, row)).alias(k)
                for k in ("first", "between", "last")
            ]
        )
    )
    kept = F.explode(F.array_compact(F.array("first", "between", "last"))).alias("row")
    return windowed.select(*by, kept).select(*by, "row.*")


def event_log(events: DataFrame) -> DataFrame:
    """Rows of the persisted log: ``kind, level, msg, ts``; late ones stay in it.

    ``events`` has ``kind, payload map<string, string>, ts``.
    """
    payload = F.col("payload")
    text = F.coalesce(
        F.try_element_at(payload, F.lit("msg")),
        F.concat(F.col("kind"), F.lit(" "), F.to_json(payload)),
    )
    level = F.coalesce(F.try_element_at(payload, F.lit("level")), F.lit("info"))
    return events.select("*", level.alias("level"), text.alias("msg"))


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def verify_count_stream(
    results: DataFrame, store: TableSet, checkpoint: str, by: Sequence[str] = ("run",)
) -> StreamingQuery:
    """Counts by status of each verification, kept up to date in the published table.

    Each batch is counted by itself and added to what is published, once, so the stream holds no
    state however many runs there have been.
    """

    def work(batch: DataFrame, number: int) -> None:
        key = [*by, "status"]
        new = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("files"))
        known = store.read("verify_counts")
        if known is not None:
            new = known.unionByName(new).groupBy(*key).agg(F.sum("files").alias("files"))
        store.publish({"verify_counts": new}, run=f"verify-counts-{number}")

    return _per_batch(results, work, checkpoint)
