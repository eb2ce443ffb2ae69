"""Verification, planning and decisions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.config import WorkingHours
from keepsake.operators import planning, verify
from keepsake.plans import jobs

FILE = "project string, rel_path string, size bigint, mtime_ns bigint, digest string"
SECOND = 1_000_000_000
NOW = datetime(2024, 6, 3, 12, 0)


def files(spark, *rows, project="p"):
    return spark.createDataFrame([(project, *r) for r in rows], FILE)


@pytest.fixture
def sides(spark):
    sealed = files(
        spark,
        ("ok", 1, 0, "a"),
        ("rot", 1, 0, "a"),
        ("rot_jitter", 1, 0, "a"),
        ("saved", 1, 0, "a"),
        ("gone", 1, 0, "a"),
        ("unknown", 1, 0, None),
        ("unread", 1, 0, "a"),
    )
    current = files(
        spark,
        ("ok", 9, 9 * SECOND, "a"),
        ("rot", 1, 0, "b"),
        ("rot_jitter", 1, SECOND, "b"),
        ("saved", 1, 60 * SECOND, "b"),
        ("new", 1, 0, "c"),
        ("unknown", 1, 0, "x"),
        ("unread", 1, 0, None),
    )
    return sealed, current


def test_statuses(sides, rows):
    got = dict(rows(verify.compare_for_verify(*sides), "rel_path", "status"))
    assert got == {
        "ok": "ok",
        "rot": "corrupt",
        "rot_jitter": "corrupt",
        "saved": "modified",
        "gone": "missing",
        "new": "added",
        "unknown": "ok",
        "unread": "unread",
    }


def test_reason_omits_zero_counts(sides):
    results = verify.compare_for_verify(*sides)
    assert verify.verify_reason(results).first().review_reason == (
        "verification: 2 corrupt, 1 modified, 1 missing; files: gone, rot, rot_jitter, saved"
    )
    gone = verify.verify_reason(results.where("status = 'missing'")).first().review_reason
    assert gone == "verification: 1 missing; files: gone"


def test_seal_then_verify_is_all_ok(spark, rows):
    now = files(spark, ("a", 1, 1, "1"), ("b", 2, 2, "2"))
    given = now.select("project", "rel_path", F.lit("xxh128").alias("fmt"), "digest")
    nothing = given.limit(0)
    past = nothing.withColumn("generation_no", F.lit(1))
    sealed = jobs.seal(now, given, nothing, past)
    assert rows(sealed.outcome, "state", "writes_generation") == [("sealed", True)]
    recorded = sealed.entries.withColumn("generation_no", F.lit(1))
    result, compared = jobs.verify_projects(sealed.sealed, now, recorded)
    assert rows(compared, "status") == [("ok",), ("ok",)]
    assert rows(result.outcome, "state", "stamps_verified") == [("sealed", True)]
    assert rows(result.entries, "action") == [("verified",), ("verified",)]


def test_seal_splits_off_problem_projects(spark, rows):
    now = files(spark, ("a", 1, 1, "1")).unionByName(files(spark, ("a", 1, 1, "1"), project="q"))
    given = now.select("project", "rel_path", F.lit("md5").alias("fmt"), "digest").unionByName(
        now.select("project", "rel_path", F.lit("xxh128").alias("fmt"), "digest")
    )
    expected = spark.createDataFrame([("q", "a", "md5", "other"), ("p", "a", "md5", "1")],
                                     "project string, rel_path string, fmt string, digest string")
    past = given.limit(0).withColumn("generation_no", F.lit(1))
    out = jobs.seal(now, given, expected, past)
    assert rows(out.outcome, "project", "state", "review_reason") == [
        ("p", "sealed", None),
        ("q", "needs_review", "1 files do not match their legacy MHL 1.x: a"),
    ]
    assert rows(out.entries, "project", "fmt", "action") == [
        ("p", "md5", "verified"), ("p", "xxh128", "original"),
    ]
    assert rows(out.sealed, "project", "digest") == [("p", "1")]
    kept, aside = jobs.accept_new_version(
        now, given, expected,
        spark.createDataFrame([("q", 3, None)], "project string, epoch int, superseded_at timestamp"),
        F.lit(NOW),
    )
    assert rows(kept.entries, "project", "fmt") == [("p", "md5"), ("p", "xxh128"), ("q", "xxh128")]
    assert aside.first().superseded_at == NOW
    assert rows(kept.outcome, "project", "epoch", "generation_no") == [("p", 1, 1), ("q", 4, 1)]


def test_seal_against_a_foreign_history(spark, rows):
    now = files(spark, ("a", 1, 1, "1"))
    given = now.select("project", "rel_path", F.lit("xxh128").alias("fmt"), "digest")
    past = spark.createDataFrame(
        [("p", "a", "xxh128", "0", 1), ("p", "lost", "xxh128", "0", 1)],
        "project string, rel_path string, fmt string, digest string, generation_no int",
    )
    out = jobs.seal(now, given, given.limit(0), past)
    assert rows(out.outcome, "state", "review_reason") == [
        ("needs_review", "files recorded in the history are missing: lost")
    ]
    assert out.entries.count() == 0 and out.sealed.count() == 0
    present = past.where("rel_path = 'a'")
    mismatch = jobs.seal(now, given, given.limit(0), present)
    assert rows(mismatch.outcome, "state", "review_reason") == [
        ("needs_review", "hash mismatch (review, not a generation): a")
    ]
    only_origin = given.withColumn("fmt", F.lit("md5"))
    wrong = jobs.seal(now, only_origin, only_origin, present.limit(0), "md5")
    assert rows(wrong.outcome, "state", "writes_generation") == [("error", False)]


def test_append(spark, rows):
    sealed = files(spark, ("a", 1, 1, "1")).unionByName(files(spark, ("a", 1, 1, "1"), project="q"))
    now = files(spark, ("a", 1, 1, "1"), ("b", 1, 1, "2")).unionByName(
        files(spark, ("a", 2, 1, "9"), ("b", 1, 1, "2"), project="q")
    )
    given = now.select("project", "rel_path", F.lit("xxh128").alias("fmt"), "digest")
    past = given.limit(0).withColumn("generation_no", F.lit(1))
    out = jobs.append(now, sealed, given, given.limit(0), past)
    assert rows(out.outcome, "project", "state", "added") == [
        ("p", "sealed", 1), ("q", "needs_review", 0),
    ]
    assert rows(out.entries, "project", "rel_path", "action") == [("p", "b", "original")]
    assert rows(out.sealed, "project", "rel_path") == [("p", "a"), ("p", "b"), ("q", "a")]
    assert rows(out.review_items, "project", "rel_path", "change") == [("q", "a", "modified")]


PROJECT = (
    "id int, rel_path string, state string, last_generation_no int, first_seen timestamp,"
    " last_sealed_at timestamp, last_verified_at timestamp"
)
WORK = (
    "id int, project_id int, kind string, trigger_kind string, state string, priority int,"
    " created_at timestamp, bypass_hours boolean"
)


def test_stagger_over_two_days(spark):
    ages = (10, 3, 9, 1, 30)
    projects = spark.createDataFrame(
        [(i + 1, f"{i + 1:02}", "sealed", 1, NOW, NOW - timedelta(days=d), None)
         for i, d in enumerate(ages)], PROJECT)
    nothing = spark.createDataFrame([], WORK)
    first = planning.stagger(projects, nothing, F.lit(NOW), 2)
    order = [r.rel_path for r in first.orderBy("position").collect()]
    assert order == ["05", "01", "03"]
    planned = spark.createDataFrame(
        [(i, int(p), "verify", "auto", "queued", 10, NOW, False) for i, p in enumerate(order)], WORK)
    again = planning.stagger(projects, planned, F.lit(NOW + timedelta(hours=2)), 2)
    assert again.count() == 0
    done = planned.withColumn("state", F.lit("done"))
    verified = projects.withColumn(
        "last_verified_at", F.when(F.col("rel_path").isin(*order), F.lit(NOW)))
    tomorrow = planning.stagger(verified, done, F.lit(NOW + timedelta(days=1)), 2)
    assert [r.rel_path for r in tomorrow.orderBy("position").collect()] == ["02", "04"]


def test_no_verification_in_working_hours(spark):
    projects = spark.createDataFrame(
        [(1, "a", "sealed", 1, NOW, NOW - timedelta(days=99), None)], PROJECT)
    nothing = spark.createDataFrame([], WORK)
    assert planning.stagger(projects, nothing, F.lit(NOW), 2, hours=WorkingHours()).count() == 0


def test_work_plan_promotes_queued_work_only(spark, rows):
    later = NOW + timedelta(minutes=1)
    requests = spark.createDataFrame(
        [
            (1, 7, "verify", "auto", "queued", 10, NOW, False),
            (2, 7, "verify", "manual", "queued", 110, later, True),
            (3, 8, "seal", "auto", "running", 30, NOW, False),
            (4, 8, "seal", "manual", "queued", 130, later, True),
            (5, None, "root_manifest", "auto", "queued", 5, NOW, False),
            (6, None, "root_manifest", "auto", "queued", 5, later, False),
            (7, 9, "seal", "auto", "queued", 30, NOW, False),
        ],
        WORK,
    )
    plan = planning.work_plan(requests)
    got = [tuple(r) for r in plan.orderBy("position").select(
        "id", "state", "trigger_kind", "priority", "bypass_hours").collect()]
    assert got == [
        (1, "queued", "manual", 110, True),
        (3, "running", "auto", 30, False),
        (7, "queued", "auto", 30, False),
        (5, "queued", "auto", 5, False),
    ]
    inside = planning.outside_hours(plan, F.lit(NOW), WorkingHours())
    assert rows(inside, "id") == [(1,)]
    night = planning.outside_hours(plan, F.lit(NOW + timedelta(hours=11)), WorkingHours())
    assert rows(night, "id") == [(1,), (5,), (7,)]


@pytest.mark.parametrize(
    ("state", "sealed", "action", "after", "kind", "refused"),
    [
        ("unsealed", False, "seal", "queued", "seal", False),
        ("sealed", True, "seal", "sealed", None, True),
        ("needs_review", True, "accept", "queued", "accept_new_version", False),
        ("needs_review", True, "postpone", "needs_review", None, False),
        ("sealed", True, "postpone", "sealed", None, True),
        ("changed", True, "update_now", "queued", "append", False),
        ("changed", False, "update_now", "changed", None, True),
        ("changed", True, "verify_now", "queued", "verify", False),
        ("hashing", True, "ignore", "hashing", None, True),
        ("missing", True, "ignore", "ignored", None, False),
        ("ignored", True, "unignore", "sealed", None, False),
        ("ignored", False, "unignore", "unsealed", None, False),
        ("sealed", True, "cancel", "sealed", None, True),
        ("sealed", True, "dance", "sealed", None, True),
    ],
)
def test_decisions(spark, state, sealed, action, after, kind, refused):
    projects = spark.createDataFrame(
        [(1, "a", state, 1 if sealed else None, NOW, None, None)], PROJECT)
    asked = spark.createDataFrame([(1, action)], "id int, action string")
    got = planning.apply_decisions(asked, projects, spark.createDataFrame([], WORK)).first()
    assert (got.new_state, got.work_kind, got.rejected is not None) == (after, kind, refused)


@pytest.mark.parametrize(
    ("project_state", "work", "action", "after", "rejected"),
    [
        ("queued", ("verify", "manual", "queued"), "cancel", "sealed", None),
        ("queued", ("append", "manual", "queued"), "cancel", "changed", None),
        ("queued", ("append", "auto", "queued"), "cancel", "queued", "nothing to cancel"),
        ("hashing", ("seal", "manual", "running"), "cancel", "hashing",
         "cancel a running job through its runner"),
        ("queued", ("seal", "auto", "queued"), "start_now", "queued", None),
        ("queued", ("verify", "auto", "queued"), "start_now", "queued", "nothing to start now"),
    ],
)
def test_decisions_on_waiting_work(spark, project_state, work, action, after, rejected):
    projects = spark.createDataFrame([(1, "a", project_state, 1, NOW, None, None)], PROJECT)
    items = spark.createDataFrame([(5, 1, work[0], work[1], work[2], 1, NOW, False)], WORK)
    asked = spark.createDataFrame([(1, action)], "id int, action string")
    got = planning.apply_decisions(asked, projects, items).first()
    assert (got.new_state, got.rejected) == (after, rejected)


def test_cancelled_verification_with_unsealed_files(spark):
    projects = spark.createDataFrame([(1, "a", "queued", 1, NOW, None, None)], PROJECT)
    items = spark.createDataFrame([(5, 1, "verify", "manual", "queued", 110, NOW, True)], WORK)
    asked = spark.createDataFrame([(1, "cancel")], "id int, action string")
    got = planning.apply_decisions(asked, projects, items, projects.select("id")).first()
    assert (got.new_state, got.work_id) == ("changed", 5)


def test_outcomes(spark, rows):
    items = spark.createDataFrame([(i, i, "seal") for i in range(1, 7)],
                                  "id int, project_id int, kind string")
    read = spark.createDataFrame(
        [(1, "ok"), (2, "ok"), (2, "changed"), (3, "error"), (5, "ok"), (6, "ok")],
        "id int, status string")
    projects = spark.createDataFrame(
        [(1, "hashing"), (2, "hashing"), (3, "hashing"), (4, "hashing"), (5, "missing")],
        "id int, state string")
    out = planning.work_outcome(items, read, projects)
    assert rows(out, "id", "work_state", "new_state") == [
        (1, "done", "sealed"), (2, "failed", "error"), (3, "failed", "error"),
        (4, "cancelled", "missing"), (5, "cancelled", "missing"), (6, "failed", None),
    ]
