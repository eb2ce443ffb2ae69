"""What to read next: due verifications, the work plan, user decisions and outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import MANUAL_BONUS, PRIORITY, WorkingHours
from keepsake.functions.text import lookup
from keepsake.functions.times import due_text, is_working, local_date
from keepsake.operators.running import number_rows


def reference_time() -> Column:
    """Last proof of integrity: verification, else seal, else first sight."""
    return F.coalesce("last_verified_at", "last_sealed_at", "first_seen")


def _open(work: DataFrame, kind: str) -> DataFrame:
    return work.where((F.col("kind") == kind) & F.col("state").isin("queued", "running"))


def due_for_verification(
    projects: DataFrame, work: DataFrame, now: Column, interval_days: int
) -> DataFrame:
    """Sealed projects whose last proof is older than the interval and not already planned."""
    limit = now - F.make_dt_interval(F.lit(interval_days))
    sealed = projects.where(
        (F.col("state") == "sealed") & F.col("last_generation_no").isNotNull()
    ).withColumn("ref_at", reference_time())
    planned = _open(work, "verify").select(F.col("project_id").alias("id")).distinct()
    return sealed.where(F.col("ref_at") <= limit).join(planned, "id", "left_anti")


def daily_cap(
    projects: DataFrame, interval_days: int, by: Sequence[str] = ()
) -> DataFrame:
    """Per archive (or one row): sealed projects and how many verifications a day cover them once
    per interval."""
    sealed = (F.col("state") == "sealed") & F.col("last_generation_no").isNotNull()
    return projects.groupBy(*by).agg(F.count_if(sealed).alias("sealed")).withColumn(
        "cap", F.ceil(F.col("sealed") / F.lit(interval_days)).cast("bigint")
    )


def stagger(
    projects: DataFrame,
    work: DataFrame,
    now: Column,
    interval_days: int,
    zone: str = "UTC",
    hours: WorkingHours | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Verifications to plan now: the oldest due ones up to what is left of the local day's cap.

    Each archive (``by``, columns of ``projects``) has its own cap and positions; without ``by`` all
    projects are one archive. Work counts for the archive of its project. Positions come from
    :func:`number_rows` and are joined with one row of room per archive.
    """
    today = local_date(now, zone)
    planned_today = work.where(
        (F.col("kind") == "verify")
        & (F.col("trigger_kind") == "auto")
        & (local_date(F.col("created_at"), zone) == today)
    )
    one = "__archive"
    key = [*by, one]
    caps = daily_cap(projects, interval_days, by).withColumn(one, F.lit(0))
    if by:
        owners = projects.select(*by, F.col("id").alias("project_id"))
        planned_today = planned_today.drop(*by).join(owners, "project_id")
    used = planned_today.groupBy(*by).agg(F.count(F.lit(1)).alias("used")).withColumn(one, F.lit(0))
    room = caps.join(used, key, "left").select(
        *key, (F.col("cap") - F.coalesce("used", F.lit(0))).alias("room")
    )
    due = number_rows(
        due_for_verification(projects, work, now, interval_days), by, ["ref_at", "rel_path"]
    )
    picked = due.withColumn(one, F.lit(0)).join(room, key).where(F.col("position") <= F.col("room"))
    if hours is not None:
        picked = picked.where(~is_working(now, hours))
    return picked.select(*by, "id", "rel_path", "ref_at", "position")


def next_verification(
    projects: DataFrame, now: Column, interval_days: int, zone: str = "UTC"
) -> DataFrame:
    """Per sealed project: ``due_at`` and its text (a date, or overdue)."""
    base = F.coalesce("last_verified_at", "last_sealed_at")
    due = base + F.make_dt_interval(F.lit(interval_days))
    return (
        projects.where((F.col("state") == "sealed") & base.isNotNull())
        .withColumn("due_at", due)
        .withColumn("next_check", due_text(F.col("due_at"), zone, now))
    )


def archive_next_verification(
    projects: DataFrame,
    now: Column,
    interval_days: int,
    zone: str = "UTC",
    by: Sequence[str] = (),
) -> DataFrame:
    """The earliest of :func:`next_verification` per archive."""
    rows = next_verification(projects, now, interval_days, zone)
    return rows.groupBy(*by).agg(F.min("due_at").alias("due_at")).withColumn(
        "next_check", due_text(F.col("due_at"), zone, now)
    )


def plan_maintenance(
    verifications: DataFrame, references: DataFrame, work: DataFrame
) -> DataFrame:
    """Planned verifications plus the references refresh, whose subject is ``.``.

    ``references`` is the row of ``references_stale``; an open refresh is not planned again.
    """
    refresh_open = _open(work, "root_manifest").select(F.lit("root_manifest").alias("kind"))
    refresh = (
        references.where("needed")
        .select(F.lit(".").alias("rel_path"), F.lit("root_manifest").alias("kind"))
        .join(refresh_open.distinct(), "kind", "left_anti")
        .select("rel_path", "kind")
    )
    return verifications.select("rel_path", F.lit("verify").alias("kind")).unionByName(refresh)


def priority(kind: Column, manual: Column) -> Column:
    return lookup(kind, PRIORITY) + F.when(manual, MANUAL_BONUS).otherwise(0)


def work_plan(requests: DataFrame) -> DataFrame:
    """Open work, one item per ``(kind, project_id)``, in the order to run it.

    ``requests`` are queued and running rows ``(id, kind, project_id, trigger_kind, state,
    priority, created_at, bypass_hours)``. The oldest row is the item; a running one is left
    alone, a queued one takes the highest priority and bypass of later manual requests. Null
    ``project_id`` is the archive itself.
    """
    manual = F.col("trigger_kind") == "manual"
    items = requests.groupBy("kind", "project_id").agg(
        F.min(F.struct("id", "state", "trigger_kind", "priority", "created_at", "bypass_hours"))
        .alias("first"),
        F.max(F.when(manual, F.struct("priority"))).alias("top"),
        F.bool_or(manual & F.col("bypass_hours")).alias("bypass"),
        F.count(F.lit(1)).alias("requests"),
    )
    promoted = (F.col("first.state") == "queued") & F.col("top").isNotNull()
    plan = items.select(
        F.col("first.id").alias("id"),
        "kind",
        "project_id",
        F.col("first.state").alias("state"),
        F.when(promoted, "manual").otherwise(F.col("first.trigger_kind")).alias("trigger_kind"),
        F.when(promoted, F.greatest("first.priority", "top.priority"))
        .otherwise(F.col("first.priority"))
        .alias("priority"),
        F.when(promoted, F.col("first.bypass_hours") | F.coalesce("bypass", F.lit(False)))
        .otherwise(F.col("first.bypass_hours"))
        .alias("bypass_hours"),
        F.col("first.created_at").alias("created_at"),
        "requests",
    )
    return number_rows(plan, [], ["-priority", "created_at", "id"])


def outside_hours(plan: DataFrame, now: Column, hours: WorkingHours) -> DataFrame:
    """Queued items that may run now: any outside working hours, inside only those that bypass."""
    return plan.where((F.col("state") == "queued") & (F.col("bypass_hours") | ~is_working(now, hours)))


# (action, state) -> state afterwards. The service's transition rules. Ignore applies
# to every state but hashing; cancel and start now depend on the waiting work, below.
TRANSITIONS: Mapping[tuple[str, str], str] = {
    ("seal", "unsealed"): "queued",
    ("accept", "needs_review"): "queued",
    ("postpone", "needs_review"): "needs_review",
    ("verify_now", "sealed"): "queued",
    ("verify_now", "changed"): "queued",
    ("update_now", "changed"): "queued",
}
WORK_OF_ACTION = {
    "seal": "seal",
    "accept": "accept_new_version",
    "verify_now": "verify",
    "update_now": "append",
}
NEEDS_HISTORY = ("verify_now", "update_now")
AFTER_CANCEL = {
    "seal": "unsealed",
    "accept_new_version": "needs_review",
    "append": "changed",
    "verify": "sealed",
}
STARTABLE = ("seal", "accept_new_version", "append")


def waiting_work(work: DataFrame, projects: DataFrame) -> DataFrame:
    """The item each queued or hashing project (``id``) waits for.

    A queued project: its queued item of highest priority, oldest first; a hashing one: its
    latest running item.
    """
    rows = work.select(
        F.col("project_id").alias("id"),
        F.col("id").alias("work_id"),
        F.col("kind").alias("work_kind"),
        F.col("state").alias("work_state"),
        F.col("trigger_kind").alias("work_trigger"),
        "priority",
        "created_at",
        "bypass_hours",
    ).where(F.col("work_state").isin("queued", "running"))
    columns = ("work_id", "work_kind", "work_trigger", "work_state", "bypass_hours")
    queued = F.struct((-F.col("priority")).alias("p"), F.col("created_at"), *columns)
    is_queued = F.col("work_state") == "queued"
    per_project = rows.groupBy("id").agg(
        F.min(F.when(is_queued, queued)).alias("first_queued"),
        F.max(F.when(~is_queued, F.struct(*columns))).alias("last_running"),
    )
    held = projects.where(F.col("state").isin("queued", "hashing")).select("id", "state")
    picked = held.join(per_project, "id", "left")
    in_queue = F.col("state") == "queued"
    return picked.select(
        "id",
        *[
            F.when(in_queue, F.col(f"first_queued.{c}")).otherwise(F.col(f"last_running.{c}"))
            .alias(c)
            for c in columns
        ],
    ).where(F.col("work_id").isNotNull())


def apply_decisions(
    decisions: DataFrame,
    projects: DataFrame,
    work: DataFrame,
    unsealed: DataFrame | None = None,
) -> DataFrame:
    """Each decision ``(id, action)`` with the resulting state, work and, if refused, ``rejected``.

    ``unsealed`` lists the ``id`` of projects that hold files the record lacks: a verification
    taken back leaves those ``changed``.
    """
    rows = decisions.select("id", "action").join(
        projects.select("id", "rel_path", "state", "last_generation_no"), "id", "left"
    ).join(waiting_work(work, projects), "id", "left")
    if unsealed is not None:
        marks = unsealed.select("id").distinct().withColumn("has_unsealed", F.lit(True))
        rows = rows.join(marks, "id", "left")
    else:
        rows = rows.withColumn("has_unsealed", F.lit(None).cast("boolean"))
    action, state = F.col("action"), F.col("state")
    sealed = F.col("last_generation_no").isNotNull()
    resting = F.when(sealed, "sealed").otherwise("unsealed")
    ruled = lookup(
        F.concat_ws(":", action, state), {f"{a}:{s}": v for (a, s), v in TRANSITIONS.items()}
    )
    cancellable = (F.col("work_trigger") == "manual") & F.col("work_kind").isin(*AFTER_CANCEL)
    after_cancel = F.when(
        (F.col("work_kind") == "verify") & F.col("has_unsealed"), "changed"
    ).otherwise(lookup(F.col("work_kind"), AFTER_CANCEL))
    startable = F.col("work_kind").isin(*STARTABLE)
    rejected = (
        F.when(state.isNull(), "no such project")
        .when(action == "cancel",
              F.when(~F.coalesce(cancellable, F.lit(False)), "nothing to cancel").when(
                  F.col("work_state") == "running", "cancel a running job through its runner"))
        .when(action == "start_now",
              F.when(~F.coalesce(startable, F.lit(False)), "nothing to start now").when(
                  F.col("work_state") == "running", "start a running job through its runner"))
        .when(action == "ignore", F.when(state == "hashing", "cannot ignore while hashing"))
        .when(action == "unignore", F.when(state != "ignored", "not ignored"))
        .when(ruled.isNull() | (action.isin(*NEEDS_HISTORY) & ~sealed),
              F.concat(action, F.lit(" does not apply to state "), state))
    )
    after = (
        F.when(rejected.isNotNull(), state)
        .when(action == "cancel", after_cancel)
        .when(action == "start_now", state)
        .when(action == "ignore", "ignored")
        .when(action == "unignore", resting)
        .otherwise(ruled)
    )
    queued_kind = F.when(rejected.isNull(), lookup(action, WORK_OF_ACTION))
    return rows.select(
        "id",
        "action",
        state.alias("old_state"),
        after.alias("new_state"),
        queued_kind.alias("work_kind"),
        F.when(queued_kind.isNotNull(), priority(queued_kind, F.lit(True))).alias("priority"),
        F.when(rejected.isNull() & action.isin("cancel", "start_now"), F.col("work_id"))
        .alias("work_id"),
        (rejected.isNull() & action.isin("verify_now", "update_now", "start_now"))
        .alias("bypass_hours"),
        rejected.alias("rejected"),
    )


def work_outcome(items: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """How executed items end: ``work_state``, ``new_state`` of the project, and ``error``.

    ``items`` has ``id, project_id``; ``files`` has ``id`` and the read ``status`` of each file
    (none left: the folder was emptied); ``projects`` has ``id, state, last_generation_no``.
    """
    read = files.groupBy("id").agg(
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.count_if(F.col("status") == "error").alias("unreadable"),
        F.count(F.lit(1)).alias("files"),
    )
    subject = projects.select(
        F.col("id").alias("project_id"), F.col("state").alias("project_state")
    )
    rows = items.select("id", "project_id", "kind").join(read, "id", "left").join(
        subject, "project_id", "left"
    )
    missing = F.col("project_state") == "missing"
    failed = F.col("changed") + F.col("unreadable") > 0
    known = F.col("project_state").isNotNull()
    state = (
        F.when(~known, "failed")
        .when(missing | F.col("files").isNull(), "cancelled")
        .when(failed, "failed")
        .otherwise("done")
    )
    error = (
        F.when(~known, "project not found")
        .when(missing, "skipped: project folder is missing")
        .when(F.col("files").isNull(), "the project folder has no files left")
        .when(F.col("changed") > 0, "file kept changing while being read")
        .when(F.col("unreadable") > 0, "read error")
    )
    after = (
        F.when(~known, F.lit(None).cast("string"))
        .when(missing | F.col("files").isNull(), "missing")
        .when(failed, "error")
        .otherwise("sealed")
    )
    return rows.select(
        "id", "kind", "project_id", state.alias("work_state"), after.alias("new_state"),
        error.alias("error"),
    )
