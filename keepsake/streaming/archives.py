"""Scans of many archives as they arrive, each treated as the batch scan treats one.

A snapshot is the listing of one archive at one scan. Every micro-batch takes the newest announced
snapshot of each archive it names through :func:`keepsake.plans.scan.scan_archive`, with what the
archive's last applied scan left behind, and publishes the new state of these archives together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.config import ArchiveConfig
from keepsake.plans.scan import scan_archive
from keepsake.session import stage, stage_table
from keepsake.sources.tables import TableSet

ARCHIVE = "archive_id"
SCHEMAS = {
    "projects": (
        "archive_id string, id bigint, rel_path string, name string, state string,"
        " review_reason string, error string, preexisting boolean, last_generation_no int,"
        " first_seen timestamp, last_scan_at timestamp, last_change_at timestamp,"
        " stable_since timestamp, file_count bigint, total_bytes bigint, missing_since timestamp,"
        " state_before_missing string"
    ),
    "files": "archive_id string, id bigint, rel_path string, size bigint, mtime_ns bigint",
    "review_items": (
        "archive_id string, id bigint, rel_path string, change string, old_size bigint,"
        " new_size bigint, old_mtime_ns bigint, new_mtime_ns bigint"
    ),
    "chains": "archive_id string, id bigint, fingerprint string",
}
_CHAINS = "archive_id string, scan_id bigint, rel_path string, fingerprint string"


def _last_applied(store: TableSet) -> DataFrame | None:
    """Of each archive the last applied scan and the publish that holds what it left."""
    applied = store.read_all("applied")
    if applied is None:
        return None
    last = F.max(F.struct("scan_id", "run")).alias("last")
    return applied.groupBy(ARCHIVE).agg(last).select(ARCHIVE, "last.scan_id", "last.run")


def current(store: TableSet, name: str) -> DataFrame | None:
    """The rows of ``projects``, ``files``, ``review_items`` or ``chains`` as of each archive's
    last applied scan."""
    rows, last = store.read_all(name), _last_applied(store)
    if rows is None or last is None:
        return None
    return rows.join(last.select(ARCHIVE, "scan_id"), [ARCHIVE, "scan_id"], "left_semi")


def seed(store: TableSet, tables: dict[str, DataFrame], now: Column) -> None:
    """Begin with known projects (and files, chains, review items) as scan 0 of their archives."""
    projects = tables["projects"]
    full = {
        name: (tables[name] if name in tables else projects.sparkSession.createDataFrame([], schema))
        .withColumns({"scan_id": F.lit(0).cast("bigint"), "run": F.lit("seed")})
        for name, schema in SCHEMAS.items()
    }
    applied = projects.groupBy(ARCHIVE).agg(F.max("id").alias("last_id")).select(
        ARCHIVE, F.lit(0).cast("bigint").alias("scan_id"), F.lit("seed").alias("run"),
        now.alias("applied_at"), "last_id",
    )
    store.publish(full | {"applied": applied}, run="seed")


def apply_archive_scans(
    announced: DataFrame,
    snapshots: DataFrame,
    sealed: DataFrame,
    store: TableSet,
    run: str,
    now: Column,
    now_ns: int,
    config: ArchiveConfig = ArchiveConfig(),
    chains: DataFrame | None = None,
) -> None:
    """Apply the newest announced scan of each archive; the others keep what they have.

    ``announced`` has ``archive_id, scan_id``: a scan is announced when its snapshot is complete.
    ``snapshots`` has ``archive_id, scan_id, path, kind, size, mtime_ns, error``, partitioned by the
    first two; an archive without a row lists nothing, and if projects of it are known it is left as
    it is. ``sealed`` has ``archive_id, project`` (the path), ``rel_path, size, mtime_ns``;
    ``chains`` the fingerprint of each project's chain, by ``archive_id, scan_id, rel_path``.

    A scan not newer than the archive's last applied one changes nothing, nor does a ``run``
    published before, so late scans and repeated batches are harmless. Published, with
    ``archive_id`` and ``scan_id``: ``projects, files, review_items, chains`` (see
    :func:`current`), and the logs ``work`` (a row per planned item and scan), ``scan_log`` and
    ``applied``. Only the batch's archives are read and written.
    """
    spark = announced.sparkSession
    if store.published(run):
        return
    last = _last_applied(store)
    asked = announced.groupBy(ARCHIVE).agg(F.max("scan_id").alias("scan_id"))
    if last is None:
        last = asked.limit(0).withColumn("run", F.lit(""))
    before = last.select(ARCHIVE, F.col("scan_id").alias("earlier"), "run")
    scans = stage(  # one row per archive of the batch
        asked.join(before, ARCHIVE, "left").where(
            F.col("earlier").isNull() | (F.col("scan_id") > F.col("earlier"))
        )
    )
    span = scans.agg(
        F.min("scan_id"), F.max("scan_id"), F.min(ARCHIVE), F.max(ARCHIVE)
    ).first()
    if span[0] is None:
        return
    runs = [r["run"] for r in scans.where("run is not null").select("run").distinct().collect()]
    held = scans.select(ARCHIVE, F.col("earlier").alias("scan_id"))

    def left_by_last(name: str) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], SCHEMAS[name])
        rows = store.read_versions(name, runs).join(held, [ARCHIVE, "scan_id"], "left_semi")
        return rows.drop("scan_id", "run")

    known = left_by_last("projects")
    # Constants prune the partitions; a join alone would list every scan that ever landed.
    newest = scans.select(ARCHIVE, "scan_id")
    listing = (
        snapshots.where(
            F.col("scan_id").between(span[0], span[1])
            & F.col(ARCHIVE).between(span[2], span[3])
        )
        .join(newest, [ARCHIVE, "scan_id"], "left_semi")
        .select(ARCHIVE, "path", "kind", "size", "mtime_ns", "error")
    )
    ids = known.select(ARCHIVE, F.col("rel_path").alias("project"), "id")
    record = sealed.join(ids, [ARCHIVE, "project"]).select("id", "rel_path", "size", "mtime_ns")
    seen_chains = (chains if chains is not None else spark.createDataFrame([], _CHAINS)).join(
        newest, [ARCHIVE, "scan_id"], "left_semi"
    ).select(ARCHIVE, "rel_path", "fingerprint")
    kept_chains, previous = left_by_last("chains"), left_by_last("files")
    applied = store.read_all("applied")
    last_id = applied.agg(F.max("last_id")).first()[0] if applied is not None else None
    result = scan_archive(
        listing, known, record, previous.drop(ARCHIVE), left_by_last("review_items").drop(ARCHIVE),
        seen_chains, kept_chains.select("id", "fingerprint"), now, now_ns, config,
        by=(ARCHIVE,), first_id=(last_id or 0) + 1,
    )
    projects = stage_table(result.projects, "projects")
    summary = stage_table(result.summary, "summary")
    shut = summary.where("unreachable").select(ARCHIVE)
    of_archive = projects.select("id", ARCHIVE)
    files = result.files.join(of_archive, "id").unionByName(
        previous.join(shut, ARCHIVE, "left_semi")
    )
    on_disk = projects.join(seen_chains, [ARCHIVE, "rel_path"]).select(ARCHIVE, "id", "fingerprint")
    all_chains = on_disk.unionByName(
        kept_chains.join(on_disk.select("id"), "id", "left_anti").select(ARCHIVE, "id", "fingerprint")
    )

    def stamped(df: DataFrame) -> DataFrame:
        return df.join(newest, ARCHIVE).withColumn("run", F.lit(run))

    most = projects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most")).first()["most"]
    applied_now = newest.select(
        ARCHIVE, "scan_id", F.lit(run).alias("run"), now.alias("applied_at"),
        F.lit(max(most, last_id or 0)).cast("bigint").alias("last_id"),
    )
    store.publish(
        {
            "projects": stamped(projects),
            "files": stamped(files),
            "review_items": stamped(result.review_items.join(of_archive, "id")),
            "chains": stamped(all_chains),
            "work": stamped(result.work).withColumn("created_at", now),
            "scan_log": stamped(summary),
            "applied": applied_now,
        },
        run=run,
    )


def archive_scan_stream(
    announcements: DataFrame,
    snapshots: Callable[[], DataFrame],
    sealed: DataFrame,
    store: TableSet,
    checkpoint: str,
    now: Column,
    now_ns: int,
    config: ArchiveConfig = ArchiveConfig(),
    chains: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Apply scans as they are announced; ``snapshots`` and ``chains`` read what landed afresh."""

    def work(batch: DataFrame, number: int) -> None:
        apply_archive_scans(
            batch, snapshots(), sealed, store, f"batch-{number}", now, now_ns, config,
            chains() if chains is not None else None,
        )

    return (
        announcements.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
