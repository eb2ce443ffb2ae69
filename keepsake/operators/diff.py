"""Snapshot comparison and the state it implies.

Snapshots are ``(project, rel_path, size, mtime_ns, …)``, unique per ``(project, rel_path)``. The
shuffle key is always the pair, so a project with a third of all files is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import HELD_STATES, MTIME_TOLERANCE_NS
from keepsake.functions.text import counted, joined, path_lists

BY = ("project",)
STAT = ("size", "mtime_ns")


def _stat(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.select(
        *by,
        "rel_path",
        F.col("size").alias(f"{prefix}_size"),
        F.col("mtime_ns").alias(f"{prefix}_mtime_ns"),
        F.lit(True).alias(f"in_{prefix}"),
    )


def differs(tolerance_ns: int) -> Column:
    """Another size, or an mtime further away than the tolerance."""
    return (F.col("old_size") != F.col("new_size")) | (
        F.abs(F.col("old_mtime_ns") - F.col("new_mtime_ns")) > tolerance_ns
    )


def diff_against_sealed(
    current: DataFrame,
    sealed: DataFrame,
    by: Sequence[str] = BY,
    tolerance_ns: int = MTIME_TOLERANCE_NS,
) -> DataFrame:
    """One row per path of either side: ``change`` and the old and new stat."""
    both = _stat(current, by, "new").join(_stat(sealed, by, "old"), [*by, "rel_path"], "full_outer")
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(differs(tolerance_ns), "modified")
        .otherwise("unchanged")
    )
    return both.select(
        *by,
        "rel_path",
        change.alias("change"),
        "old_size",
        "old_mtime_ns",
        "new_size",
        "new_mtime_ns",
    )


def stability(
    current: DataFrame,
    previous: DataFrame,
    scanned: DataFrame | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``stable`` per project: an earlier scan exists and lists exactly the same stats.

    ``scanned`` names the projects an earlier scan covered; by default those with a row in it.
    """
    both = _stat(current, by, "new").join(
        _stat(previous, by, "old"), [*by, "rel_path"], "full_outer"
    )
    same = (
        F.col("in_old").isNotNull()
        & F.col("in_new").isNotNull()
        & (F.col("old_size") == F.col("new_size"))
        & (F.col("old_mtime_ns") == F.col("new_mtime_ns"))
    )
    per_project = both.groupBy(*by).agg(
        F.count_if(~same).alias("mismatches"), F.count_if(F.col("in_old")).alias("earlier")
    )
    if scanned is None:
        known = F.col("earlier") > 0
    else:
        marks = scanned.select(*by).distinct().withColumn("was_scanned", F.lit(True))
        per_project = per_project.join(marks, list(by), "full_outer")
        known = F.col("was_scanned").isNotNull()
    return per_project.select(
        *by, (known & (F.coalesce("mismatches", F.lit(0)) == 0)).alias("stable")
    )


def diff_summary(
    current: DataFrame,
    sealed: DataFrame,
    previous: DataFrame | None = None,
    by: Sequence[str] = BY,
    tolerance_ns: int = MTIME_TOLERANCE_NS,
) -> DataFrame:
    """Everything a scan decides on, one row per project, from one shuffle of the three snapshots.

    The snapshots are tagged and grouped on ``(project, rel_path)``; the buffers are numbers only,
    so both aggregations are hash aggregates, and the second one is combined before its shuffle.
    """
    none = F.lit(None).cast("bigint")

    def tagged(df: DataFrame, side: str) -> DataFrame:
        stats = []
        for name in ("new", "old", "prev"):
            hit = name == side
            stats.append((F.col("size") if hit else none).alias(f"{name}_size"))
            stats.append((F.col("mtime_ns") if hit else none).alias(f"{name}_mtime_ns"))
        return df.select(*by, "rel_path", *stats)

    rows = tagged(current, "new").unionByName(tagged(sealed, "old"))
    if previous is not None:
        rows = rows.unionByName(tagged(previous, "prev"))
    columns = [f"{n}_{s}" for n in ("new", "old", "prev") for s in STAT]
    per_path = rows.groupBy(*by, "rel_path").agg(*[F.max(c).alias(c) for c in columns])
    here, was, before = (F.col(f"{n}_mtime_ns").isNotNull() for n in ("new", "old", "prev"))
    modified = here & was & differs(tolerance_ns)
    same_as_before = (
        here
        & before
        & (F.col("new_size") == F.col("prev_size"))
        & (F.col("new_mtime_ns") == F.col("prev_mtime_ns"))
    ) | (~here & ~before)
    out = per_path.groupBy(*by).agg(
        F.count_if(here & ~was).alias("added"),
        F.count_if(modified).alias("modified"),
        F.count_if(was & ~here).alias("deleted"),
        F.count_if(here & was & ~modified).alias("unchanged"),
        F.count_if(here).alias("files"),
        F.coalesce(F.sum("new_size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.max("new_mtime_ns"), F.lit(0)).alias("newest_mtime_ns"),
        F.count_if(~same_as_before).alias("mismatches"),
        F.count_if(before).alias("earlier"),
    )
    return out.withColumn("stable", (F.col("earlier") > 0) & (F.col("mismatches") == 0)).drop(
        "mismatches", "earlier"
    )


def is_settled(stable: Column, newest_ns: Column, now_ns: int, settle_hours: float) -> Column:
    return stable & (F.lit(now_ns) - newest_ns >= int(settle_hours * 3600 * 10**9))


def settled(summary: DataFrame, now_ns: int, settle_hours: float) -> DataFrame:
    """Add ``settled``: stable and nothing written for ``settle_hours`` (inclusive)."""
    return summary.withColumn(
        "settled", is_settled(F.col("stable"), F.col("newest_mtime_ns"), now_ns, settle_hours)
    )


def unsealed_files(current: DataFrame, sealed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Present files the record lacks or holds with another size or mtime (no tolerance)."""
    return current.join(sealed.select(*by, "rel_path", *STAT), [*by, "rel_path", *STAT], "left_anti")


def review_reason(diff: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``review_reason`` per project with a modified or deleted path."""
    bad = diff.where(F.col("change").isin("modified", "deleted"))
    lists = path_lists(
        bad,
        by,
        modified=F.count_if(F.col("change") == "modified"),
        deleted=F.count_if(F.col("change") == "deleted"),
    )
    head = joined(
        [counted(F.col("modified"), "modified"), counted(F.col("deleted"), "deleted")], " and "
    )
    return lists.select(
        *by,
        F.concat(head, F.lit(" since the last seal: "), F.col("listed")).alias("review_reason"),
    )


def review_items(
    diff: DataFrame, stored: DataFrame | None = None, by: Sequence[str] = BY
) -> DataFrame:
    """Modified and deleted paths; a project whose diff is empty keeps its stored list."""
    columns = [*by, "rel_path", "change", "old_size", "new_size", "old_mtime_ns", "new_mtime_ns"]
    fresh = diff.where(F.col("change").isin("modified", "deleted")).select(*columns)
    if stored is None:
        return fresh
    renewed = fresh.select(*by).distinct()
    return fresh.unionByName(stored.select(*columns).join(renewed, list(by), "left_anti"))


def classified(state: Column, sealed: Column) -> Column:
    """The state a scan implies; ``modified``, ``deleted``, ``added`` are counts of the diff."""
    changed = F.coalesce("modified", F.lit(0)) + F.coalesce("deleted", F.lit(0)) > 0
    return (
        F.when(state.isin(*HELD_STATES, "needs_review"), state)
        .when(~sealed, "unsealed")
        .when(changed, "needs_review")
        .when(F.coalesce("added", F.lit(0)) > 0, "changed")
        .otherwise("sealed")
    )


def classify(
    projects: DataFrame,
    summary: DataFrame,
    reasons: DataFrame | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Projects with ``new_state`` and ``new_reason``.

    ``projects`` has ``state, review_reason, last_generation_no``.
    """
    counts = summary.select(*by, "added", "modified", "deleted")
    joined_rows = projects.join(counts, list(by), "left")
    state = classified(F.col("state"), F.col("last_generation_no").isNotNull())
    out = joined_rows.withColumn("new_state", state)
    if reasons is None:
        return out
    fresh = reasons.select(*by, F.col("review_reason").alias("fresh_reason"))
    held = F.col("state").isin(*HELD_STATES, "needs_review")
    reason = F.when(held, F.col("review_reason")).when(
        F.col("new_state") == "needs_review", F.col("fresh_reason")
    )
    return out.join(fresh, list(by), "left").withColumn("new_reason", reason).drop("fresh_reason")


def scan_health(entries: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Projects with an unreadable entry: in ``error``, not classified.

    ``entries`` has ``rel_path`` and ``error`` (null when readable).
    """
    bad = entries.where(F.col("error").isNotNull()).withColumn(
        "entry", F.concat("rel_path", F.lit(": "), "error")
    )
    lists = path_lists(bad, by, path="entry")
    return lists.select(
        *by,
        F.col("n_paths").alias("errors"),
        F.lit("error").alias("state"),
        F.concat(F.lit("scan errors: "), "listed").alias("error"),
    )


def auto_work(projects: DataFrame) -> DataFrame:
    """``work`` for each project: ``seal``, ``append`` or null.

    ``projects`` has ``state`` (just classified), ``preexisting`` and ``settled``.
    """
    kind = F.when(
        (F.col("state") == "unsealed") & ~F.col("preexisting") & F.col("settled"), "seal"
    ).when((F.col("state") == "changed") & F.col("settled"), "append")
    return projects.withColumn("work", kind)


def update_scan_fields(
    projects: DataFrame, summary: DataFrame, now: Column, by: Sequence[str] = BY
) -> DataFrame:
    """Scan counters and the change and stability times of every scanned project."""
    fields = summary.select(
        *by,
        F.col("files").alias("__files"),
        F.col("total_bytes").alias("__bytes"),
        F.col("stable").alias("__stable"),
    )
    scanned = F.col("__stable").isNotNull()
    unstable = scanned & ~F.col("__stable")
    out = projects.join(fields, list(by), "left")
    values = {
        "last_scan_at": F.when(scanned, now).otherwise(F.col("last_scan_at")),
        "file_count": F.coalesce("__files", "file_count"),
        "total_bytes": F.coalesce("__bytes", "total_bytes"),
        "last_change_at": F.when(unstable, now).otherwise(F.col("last_change_at")),
        "stable_since": F.when(unstable | (scanned & F.col("stable_since").isNull()), now)
        .otherwise(F.col("stable_since")),
    }
    return out.withColumns(values).drop("__files", "__bytes", "__stable")


def mark_preexisting(
    discovered: DataFrame, known: DataFrame, first_discovery: bool, now: Column
) -> DataFrame:
    """Known projects keep the mark; new ones are preexisting iff this is the first discovery."""
    fresh = discovered.select(F.col("rel_path"), F.col("name").alias("__name"))
    out = known.join(fresh, "rel_path", "full_outer")
    new = F.col("first_seen").isNull()
    return out.select(
        "rel_path",
        F.coalesce("__name", "name").alias("name"),
        F.when(new, F.lit(first_discovery)).otherwise(F.col("preexisting")).alias("preexisting"),
        F.when(new, now).otherwise(F.col("first_seen")).alias("first_seen"),
    )
