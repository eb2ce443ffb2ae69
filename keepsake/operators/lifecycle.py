"""Projects that vanish, return, move or are forgotten."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import TRANSIENT_STATES
from keepsake.operators.discovery import ancestor_rows
from keepsake.operators.running import number_rows


class ArchiveUnavailable(RuntimeError):
    """The listing shows no project while some are known: an unmounted share, not a deletion."""


def resting_state() -> Column:
    return F.when(F.col("last_generation_no").isNotNull(), "sealed").otherwise("unsealed")


def _settle_transient(state: Column) -> Column:
    return F.when(
        state.isNull() | state.isin(*TRANSIENT_STATES, "missing"), resting_state()
    ).otherwise(state)


def unreachable_guard(
    discovered: DataFrame, known: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per archive (or one row): counts and whether the run must stop before it writes anything."""
    listed = discovered.select(*by, F.lit(True).alias("listed"))
    expected = known.where(F.col("state") != "ignored").select(*by, F.lit(False).alias("listed"))
    return (
        listed.unionByName(expected)
        .groupBy(*by)
        .agg(F.count_if("listed").alias("discovered"), F.count_if(~F.col("listed")).alias("known"))
        .withColumn("unreachable", (F.col("discovered") == 0) & (F.col("known") > 0))
    )


def require_reachable(discovered: DataFrame, known: DataFrame) -> None:
    if discovered.isEmpty() and not known.where(F.col("state") != "ignored").isEmpty():
        raise ArchiveUnavailable("the archive lists no projects")


def vanished(
    known: DataFrame,
    discovered: DataFrame,
    listing_errors: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Known projects the listing lacks, with ``confirmed``.

    Below a folder that failed to list, absence is not confirmed (a project already missing needs
    no confirmation). ``listing_errors`` has ``path``.
    """
    key = [*by, "rel_path"]
    gone = known.where(F.col("state") != "ignored").join(
        discovered.select(*key), key, "left_anti"
    )
    if listing_errors is None:
        return gone.withColumn("confirmed", F.lit(True))
    hidden = (
        ancestor_rows(gone.select(*key))
        .join(
            listing_errors.select(*by, F.col("path").alias("ancestor")),
            [*by, "ancestor"],
            "left_semi",
        )
        .select(*key)
        .distinct()
        .withColumn("__hidden", F.lit(True))
    )
    return (
        gone.join(hidden, key, "left")
        .withColumn("confirmed", (F.col("state") == "missing") | F.col("__hidden").isNull())
        .drop("__hidden")
    )


def mark_missing(
    known: DataFrame,
    discovered: DataFrame,
    now: Column,
    listing_errors: DataFrame | None = None,
) -> DataFrame:
    """Rows of the projects that are missing now; one already missing keeps its date."""
    gone = vanished(known, discovered, listing_errors).where("confirmed").drop("confirmed")
    fresh = F.col("state") != "missing"
    return gone.withColumns(
        {
            "missing_since": F.when(fresh, now).otherwise(F.col("missing_since")),
            "state_before_missing": F.when(fresh, _settle_transient(F.col("state"))).otherwise(
                F.col("state_before_missing")
            ),
            "newly_missing": fresh,
        }
    ).withColumn("state", F.lit("missing"))


def cancel_open_work(work: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """Queued work of the given projects (``id``) ends cancelled."""
    marks = projects.select(F.col("id").alias("project_id")).distinct()
    marks = marks.withColumn("__gone", F.lit(True))
    hit = F.col("__gone").isNotNull() & (F.col("state") == "queued")
    return (
        work.join(marks, "project_id", "left")
        .withColumn("finished_at", F.when(hit, now).otherwise(F.col("finished_at")))
        .withColumn("state", F.when(hit, "cancelled").otherwise(F.col("state")))
        .drop("__gone")
    )


def restore(known: DataFrame, discovered: DataFrame) -> DataFrame:
    """Missing projects that are listed again: their state and whether to verify them."""
    back = known.where(F.col("state") == "missing").join(
        discovered.select("rel_path"), "rel_path", "left_semi"
    )
    state = _settle_transient(F.col("state_before_missing"))
    sealed = F.col("last_generation_no").isNotNull()
    return (
        back.withColumn("state", state)
        .withColumn("verify", sealed & F.col("state").isin("sealed", "changed"))
        .withColumn("missing_since", F.lit(None).cast("timestamp"))
        .withColumn("state_before_missing", F.lit(None).cast("string"))
    )


def match_moved(
    candidates: DataFrame, gone: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``(id, old_path, new_path)``: new folders that are vanished projects under another path.

    ``candidates`` has ``rel_path, fingerprint``; ``gone`` has ``id, rel_path, fingerprint,
    missing_since`` (null: missed by this very scan). Candidates in path order each take the most
    recently missed project with their fingerprint that is left. All members of a fingerprint
    match each other, so pairing the two orders position by position is that rule; the positions
    are numbered without bringing a fingerprint together in one task.
    """
    left = number_rows(
        candidates.where(F.col("fingerprint").isNotNull()).select(*by, "fingerprint", "rel_path"),
        [*by, "fingerprint"],
        ["rel_path"],
        "rank",
    ).select(*by, "fingerprint", "rank", F.col("rel_path").alias("new_path"))
    ordered = gone.where(F.col("fingerprint").isNotNull()).withColumn(
        "__missed_now", F.col("missing_since").isNull()
    )
    right = number_rows(
        ordered.select(*by, "fingerprint", "__missed_now", "missing_since", "rel_path", "id"),
        [*by, "fingerprint"],
        ["-__missed_now", "-missing_since", "rel_path"],
        "rank",
    ).select(*by, "fingerprint", "rank", "id", F.col("rel_path").alias("old_path"))
    return left.join(right, [*by, "fingerprint", "rank"]).select(
        *by, "id", "old_path", "new_path"
    )


def rename_project(projects: DataFrame, moved: DataFrame) -> DataFrame:
    """The project row follows its folder; facts are keyed by ``id`` and stay as they are."""
    new_name = F.element_at(F.split("new_path", "/"), -1)
    return (
        projects.join(moved.select("id", "new_path"), "id", "left")
        .withColumn("name", F.coalesce(new_name, F.col("name")))
        .withColumn("rel_path", F.coalesce("new_path", "rel_path"))
        .drop("new_path")
    )


def forgettable(projects: DataFrame, requested: DataFrame, work: DataFrame) -> DataFrame:
    """Requested projects (``id``) with ``refused``: null, or why they stay."""
    running = (
        work.where(F.col("state") == "running")
        .select(F.col("project_id").alias("id"))
        .distinct()
        .withColumn("__running", F.lit(True))
    )
    refused = F.when(F.col("state") != "missing", "only a missing project can be retired").when(
        F.col("__running"), "a job is still stopping"
    )
    return (
        requested.select("id")
        .join(projects, "id")
        .join(running, "id", "left")
        .withColumn("refused", refused)
        .drop("__running")
    )


def forget(table: DataFrame, tombstones: DataFrame, key: str = "project_id") -> DataFrame:
    """``table`` without the rows of the forgotten projects (``id``)."""
    return table.join(tombstones.select(F.col("id").alias(key)), key, "left_anti")


def forget_trace(tombstones: DataFrame, now: Column) -> DataFrame:
    """The only rows a forgotten project leaves."""
    return tombstones.select(
        F.lit("retire").alias("kind"),
        F.lit("manual").alias("trigger_kind"),
        F.lit("done").alias("state"),
        now.alias("finished_at"),
        F.concat(F.lit("retired "), "rel_path", F.lit(" (history mirror deleted)")).alias("msg"),
    )


def scan_summary(
    discovered: DataFrame,
    known: DataFrame,
    listing_errors: DataFrame | None = None,
    moved: DataFrame | None = None,
    enqueued: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts of one scan run, one row (per archive)."""
    key = [*by, "rel_path"]
    sides = discovered.select(*key, F.lit(True).alias("listed")).join(
        known.select(*key, "state"), key, "full_outer"
    )
    listed, tracked = F.col("listed").isNotNull(), F.col("state").isNotNull()
    active = F.col("state") != "ignored"
    lost = vanished(known, discovered, listing_errors, by)
    parts = [
        sides.select(
            *by,
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(listed, "discovered"),
                        F.when(listed & ~tracked, "new"),
                        F.when(listed & (F.col("state") == "missing"), "reappeared"),
                        F.when(listed & (~tracked | active), "scanned"),
                    )
                )
            ).alias("what")
        ),
        lost.select(*by, F.when(F.col("confirmed"), "missing").otherwise("errors").alias("what")),
    ]
    for name, rows in (("moved", moved), ("enqueued", enqueued)):
        if rows is not None:
            parts.append(rows.select(*by, F.lit(name).alias("what")))
    names = ("discovered", "new", "missing", "reappeared", "moved", "scanned", "enqueued", "errors")
    total = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(
        *[F.count_if(F.col("what") == n).alias(n) for n in names]
    )
    return total.withColumns(
        {"new": F.col("new") - F.col("moved"), "missing": F.col("missing") - F.col("moved")}
    )
