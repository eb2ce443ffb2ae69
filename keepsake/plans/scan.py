"""One scan of an archive: listing in; projects, work, review items and counts out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import DEFAULT_PATTERNS, TRANSIENT_STATES, ArchiveConfig
from keepsake.operators import diff, discovery, lifecycle
from keepsake.operators.running import number_rows
from keepsake.session import stage
from keepsake.sources.inventory import listing_errors

BY = ("id",)
PROJECT_COLUMNS = (
    "id",
    "rel_path",
    "name",
    "state",
    "review_reason",
    "error",
    "preexisting",
    "last_generation_no",
    "first_seen",
    "last_scan_at",
    "last_change_at",
    "stable_since",
    "file_count",
    "total_bytes",
    "missing_since",
    "state_before_missing",
)


@dataclass(frozen=True)
class ScanResult:
    projects: DataFrame
    files: DataFrame  # (id, rel_path, size, mtime_ns): the next scan's ``previous``
    work: DataFrame  # (archive's key, id, kind)
    review_items: DataFrame
    summary: DataFrame


def _reconciled(
    known: DataFrame, candidates: DataFrame, gone: DataFrame, moved: DataFrame, now: Column,
    first_discovery: bool, by: Sequence[str] = (), first_id: int | None = None,
) -> DataFrame:
    """The project rows after moves, losses, returns and discoveries, with ``event``."""
    flags = (
        known.join(moved.select("id", "new_path"), "id", "left")
        .join(gone.select("id", F.lit(True).alias("__gone")), "id", "left")
        .join(
            candidates.select(*by, "rel_path", F.lit(True).alias("__listed")),
            [*by, "rel_path"],
            "left",
        )
    )
    resting = lifecycle.resting_state()
    was_missing = F.col("state") == "missing"

    def settle(state: Column) -> Column:
        unfit = state.isNull() | state.isin(*TRANSIENT_STATES, "missing")
        return F.when(unfit, resting).otherwise(state)

    event = (
        F.when(F.col("new_path").isNotNull(), "moved")
        .when(F.col("__gone"), "missing")
        .when(was_missing & F.col("__listed"), "back")
        .when(F.col("__listed") & (F.col("state") != "ignored"), "scanned")
        .otherwise("kept")
    )
    earlier = settle(F.when(was_missing, F.col("state_before_missing")).otherwise(F.col("state")))
    leaves = event == "missing"
    returns = event.isin("moved", "back")
    nothing = F.lit(None)
    tracked = flags.select(
        *by,
        "id",
        F.coalesce("new_path", "rel_path").alias("rel_path"),
        F.coalesce(F.element_at(F.split("new_path", "/"), -1), F.col("name")).alias("name"),
        F.when(leaves, "missing").when(returns, earlier).otherwise(F.col("state")).alias("state"),
        "review_reason",
        F.when(~leaves & ~returns, F.col("error")).alias("error"),
        "preexisting",
        "last_generation_no",
        "first_seen",
        "last_scan_at",
        "last_change_at",
        "stable_since",
        "file_count",
        "total_bytes",
        F.when(returns, nothing).when(leaves & ~was_missing, now)
        .otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(returns, nothing).when(leaves & ~was_missing, settle(F.col("state")))
        .otherwise(F.col("state_before_missing")).alias("state_before_missing"),
        event.alias("event"),
    )
    key = [*by, "rel_path"]
    fresh = candidates.join(known.select(*key), key, "left_anti").join(
        moved.select(*by, F.col("new_path").alias("rel_path")), key, "left_anti"
    )
    preexisting = F.lit(first_discovery)
    if by:  # what the first scan of an archive finds was there before
        seen = known.select(*by).distinct().withColumn("__seen", F.lit(True))
        fresh = fresh.join(seen, list(by), "left")
        preexisting = F.col("__seen").isNull()
    last = (first_id - 1) if first_id is not None else known.agg(F.max("id")).first()[0] or 0
    types = dict(tracked.dtypes)
    named = fresh.select(*key, "name", preexisting.alias("__preexisting"))
    new = number_rows(named, [], key, "n").select(
        *[
            {
                **{c: F.col(c) for c in by},
                "id": (F.col("n") + last).cast(types["id"]),
                "rel_path": F.col("rel_path"),
                "name": F.col("name"),
                "state": F.lit("unsealed"),
                "preexisting": F.col("__preexisting"),
                "first_seen": now,
                "event": F.lit("new"),
            }
            .get(c, F.lit(None).cast(types[c]))
            .alias(c)
            for c in tracked.columns
        ]
    )
    return tracked.unionByName(new)


def scan_archive(
    listing: DataFrame,
    known: DataFrame,
    sealed: DataFrame,
    previous: DataFrame,
    stored_items: DataFrame,
    chains: DataFrame,
    kept_chains: DataFrame,
    now: Column,
    now_ns: int,
    config: ArchiveConfig = ArchiveConfig(),
    first_discovery: bool = False,
    by: Sequence[str] = (),
    first_id: int | None = None,
) -> ScanResult:
    """Discover, reconcile, diff, classify and plan.

    ``listing`` is the archive's ``(path, kind, size, mtime_ns, error)``; ``known`` the project
    rows; ``sealed`` and ``previous`` ``(id, rel_path, size, mtime_ns)``; ``chains`` the
    ``fingerprint`` of each chain on disk by project ``rel_path``, ``kept_chains`` those recorded
    by ``id``. Raises before anything is computed further if the archive lists no project while
    some are known. Nothing is written here.

    With ``by``, the archive's key, the tables hold the scans of many archives, whose projects'
    ids are unique among all of them (new ones are numbered from ``first_id``). An archive that
    lists no project while some are known is then left as it is, and has ``unreachable`` set in
    the summary, while the others are scanned; what the first scan of an archive finds counts as
    there before.
    """
    depth, prefixes = config.project_depth, config.ignore_prefixes
    inside = discovery.with_project(listing, depth, prefixes)
    key, columns = [*by, "rel_path"], [*by, *PROJECT_COLUMNS]
    found = discovery.discover_projects(listing, depth, prefixes, by)
    untouched = None
    # An emptied project is listed: its archive is there, and it is the project that is gone.
    listed = found.select(*key).unionByName(discovery.empty_folders(listing, depth, prefixes, by))
    if by:
        guard = stage(lifecycle.unreachable_guard(listed, known, by))  # one row per archive
        shut = guard.where("unreachable").select(*by)
        untouched = known.join(shut, list(by), "left_semi")
        known = known.join(shut, list(by), "left_anti")
    else:
        lifecycle.require_reachable(listed, known)
    contents = discovery.project_contents(
        listing, depth, prefixes, DEFAULT_PATTERNS, config.exclude_globs, by
    )
    candidates = stage(discovery.drop_empty_projects(found, contents, known, by))
    errors = listing_errors(listing, by)
    absent = stage(
        lifecycle.vanished(known, candidates, errors, by).select(
            *by, "id", "rel_path", "missing_since", "confirmed"
        )
    )
    gone = absent.where("confirmed")
    new = candidates.join(known.select(*key), key, "left_anti")
    moved = stage(
        lifecycle.match_moved(new.join(chains, key), gone.join(kept_chains, "id"), by)
    )
    really_gone = gone.join(moved.select("id"), "id", "left_anti")
    projects = stage(
        _reconciled(known, candidates, really_gone, moved, now, first_discovery, by, first_id)
    )

    scanned = projects.where(~F.col("event").isin("kept", "missing"))
    keys = scanned.select(*by, "id", F.col("rel_path").alias("project"))
    own = inside.join(keys, [*by, "project"])
    entries = own.select("id", "rel_path", "size", "mtime_ns", "kind", "error")
    kept = discovery.apply_exclude_globs(
        discovery.apply_ignore_patterns(entries), config.exclude_globs
    )
    # Kept as the next scan's previous one anyway; the listing is filtered once.
    files = stage(
        discovery.regular_files(kept)
        .where(F.col("error").isNull())
        .select("id", "rel_path", "size", "mtime_ns")
    )
    of_scanned = [
        df.join(scanned.select("id"), "id", "left_semi") for df in (sealed, previous)
    ]
    summary = stage(
        diff.settled(
            diff.diff_summary(files, *of_scanned, BY, config.tolerance_ns),
            now_ns,
            config.settle_hours,
        )
    )
    health = diff.scan_health(kept.select("id", "rel_path", "error"), BY).select(
        "id", F.col("error").alias("scan_error")
    )
    rows = diff.diff_against_sealed(files, of_scanned[0], BY, config.tolerance_ns)
    changes = stage(rows.where(F.col("change").isin("modified", "deleted")))
    decided = diff.classify(scanned, summary, diff.review_reason(changes, BY), BY).join(
        health, "id", "left"
    )
    totals = summary.select(
        "id", "files", F.col("total_bytes").alias("bytes"), "stable", "settled"
    )
    decided = decided.drop("added", "modified", "deleted").join(totals, "id", "left")
    broken = F.col("scan_error").isNotNull()
    # A tracked project whose folder was emptied is a deleted project.
    emptied = ~broken & (F.coalesce("files", F.lit(0)) == 0)
    outcome = (
        F.when(broken, "error").when(emptied, "missing").otherwise(F.col("new_state"))
    )
    planned = diff.auto_work(
        decided.withColumns(
            {
                "state": outcome,
                "old_state": F.col("state"),
                "settled": F.coalesce("settled", F.lit(False)),
            }
        )
    )
    counted = ~broken & ~emptied
    moved_bits = counted & ~F.coalesce("stable", F.lit(False))
    current = stage(
        planned.withColumns(
            {
                "review_reason": F.when(counted, F.col("new_reason")).otherwise(
                    F.col("review_reason")
                ),
                "error": F.when(broken, F.col("scan_error")).when(
                    F.col("state").isin("ignored", "queued", "hashing"), F.col("error")
                ),
                "state_before_missing": F.when(
                    emptied,
                    F.when(F.col("old_state").isin(*TRANSIENT_STATES), lifecycle.resting_state())
                    .otherwise(F.col("old_state")),
                ).otherwise(F.col("state_before_missing")),
                "missing_since": F.when(emptied, now).otherwise(F.col("missing_since")),
                "last_scan_at": F.when(counted, now).otherwise(F.col("last_scan_at")),
                "file_count": F.when(counted, F.col("files")).otherwise(F.col("file_count")),
                "total_bytes": F.when(counted, F.col("bytes")).otherwise(F.col("total_bytes")),
                "last_change_at": F.when(moved_bits, now).otherwise(F.col("last_change_at")),
                "stable_since": F.when(
                    moved_bits | (counted & F.col("stable_since").isNull()), now
                ).otherwise(F.col("stable_since")),
            }
        )
    )
    queued = current.withColumn(
        "state", F.when(F.col("work").isNotNull(), "queued").otherwise(F.col("state"))
    )
    rest = projects.where(F.col("event").isin("kept", "missing"))
    result = queued.select(*columns).unionByName(rest.select(*columns))
    if untouched is not None:
        result = result.unionByName(untouched.select(*columns))
    verify = projects.where(
        (F.col("event") == "back")
        & F.col("last_generation_no").isNotNull()
        & F.col("state").isin("sealed", "changed")
    )
    work = current.where(F.col("work").isNotNull()).select(*by, "id", F.col("work").alias("kind"))
    work = verify.select(*by, "id", F.lit("verify").alias("kind")).unionByName(work)
    in_review = current.where(F.col("state") == "needs_review").select("id")
    held = current.where(F.col("state").isin("ignored", "queued", "hashing")).select("id")
    stays = stored_items.join(in_review.unionByName(held).unionByName(
        rest.select("id")).distinct(), "id", "left_semi")
    sealed_in_review = current.where(
        (F.col("state") == "needs_review") & F.col("last_generation_no").isNotNull()
    ).select("id")
    items = diff.review_items(
        changes.join(sealed_in_review, "id", "left_semi"), stays, BY
    )
    counts = lifecycle.scan_summary(candidates, known, errors, moved, work, by)
    if by:
        counts = counts.join(guard.select(*by, "unreachable"), list(by), "full_outer")
    return ScanResult(result, files, work, items, counts)
