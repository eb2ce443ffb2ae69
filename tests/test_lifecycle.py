"""Vanished, returned, moved and forgotten projects."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake.operators import lifecycle

KNOWN = (
    "id int, rel_path string, name string, state string, last_generation_no int,"
    " missing_since timestamp, state_before_missing string"
)
OLD = datetime(2024, 1, 1)


@pytest.fixture
def now():
    return F.lit(datetime(2024, 6, 1))


def known(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], KNOWN)


def listing(spark, *paths):
    return spark.createDataFrame([(p, p) for p in paths], "rel_path string, name string")


def test_guard(spark):
    projects = known(spark, ("y/a", "a", "sealed", 1, None, None))
    with pytest.raises(lifecycle.ArchiveUnavailable):
        lifecycle.require_reachable(listing(spark), projects)
    ignored = known(spark, ("y/a", "a", "ignored", 1, None, None))
    lifecycle.require_reachable(listing(spark), ignored)
    assert lifecycle.unreachable_guard(listing(spark), projects).first().unreachable


def test_mark_missing(spark, rows, now):
    projects = known(
        spark,
        ("y/a", "a", "sealed", 1, None, None),
        ("y/b", "b", "hashing", 1, None, None),
        ("y/c", "c", "error", None, None, None),
        ("y/d", "d", "missing", 1, OLD, "changed"),
        ("z/e", "e", "sealed", 1, None, None),
        ("z/f", "f", "missing", 1, OLD, "sealed"),
        ("y/g", "g", "ignored", 1, None, None),
        ("y/h", "h", "sealed", 1, None, None),
    )
    errors = spark.createDataFrame([("z",)], "path string")
    out = lifecycle.mark_missing(projects, listing(spark, "y/h"), now, errors)
    new = datetime(2024, 6, 1)
    assert rows(out, "rel_path", "state_before_missing", "missing_since", "newly_missing") == [
        ("y/a", "sealed", new, True),
        ("y/b", "sealed", new, True),
        ("y/c", "unsealed", new, True),
        ("y/d", "changed", OLD, False),
        ("z/f", "sealed", OLD, False),  # z/e lies below a folder that failed to list
    ]


def test_restore(spark, rows):
    projects = known(
        spark,
        ("y/a", "a", "missing", 1, OLD, "changed"),
        ("y/b", "b", "missing", 1, OLD, "queued"),
        ("y/c", "c", "missing", None, OLD, None),
        ("y/d", "d", "missing", 1, OLD, "needs_review"),
        ("y/e", "e", "missing", 1, OLD, "sealed"),
    )
    out = lifecycle.restore(projects, listing(spark, "y/a", "y/b", "y/c", "y/d"))
    assert rows(out, "rel_path", "state", "verify") == [
        ("y/a", "changed", True),
        ("y/b", "sealed", True),
        ("y/c", "unsealed", False),
        ("y/d", "needs_review", False),
    ]


def greedy(candidates, gone):
    """The rule one candidate at a time."""
    left, out = list(gone), []
    for path, mark in sorted(candidates):
        matches = [g for g in left if g[2] == mark]
        if matches:
            matches.sort(key=lambda g: g[1])
            matches.sort(key=lambda g: g[3] or datetime(2099, 1, 1), reverse=True)
            left.remove(matches[0])
            out.append((matches[0][0], matches[0][1], path))
    return sorted(out)


@pytest.mark.usefixtures("many_segments")
@pytest.mark.parametrize("seed", range(4))
def test_match_moved_equals_the_greedy_rule(spark, rows, seed):
    pick = random.Random(seed)
    marks = ["hot", "hot", "hot", "a", "b"]
    candidates = [(f"n{i:03}", pick.choice(marks)) for i in range(60)]
    gone = [
        (i, f"o{pick.randrange(10**6):06}", pick.choice(marks),
         pick.choice([None, datetime(2024, 1, 1 + i % 5)]))
        for i in range(50)
    ]
    got = lifecycle.match_moved(
        spark.createDataFrame(candidates, "rel_path string, fingerprint string"),
        spark.createDataFrame(
            gone, "id int, rel_path string, fingerprint string, missing_since timestamp"
        ),
    )
    assert rows(got, "id", "old_path", "new_path") == sorted(greedy(candidates, gone), key=repr)


def test_most_recently_missed_twin_wins(spark, rows):
    gone = spark.createDataFrame(
        [(1, "y/early", "c", OLD), (2, "y/late", "c", datetime(2024, 5, 1))],
        "id int, rel_path string, fingerprint string, missing_since timestamp",
    )
    new = spark.createDataFrame([("y/back", "c"), ("y/no", None)],
                                "rel_path string, fingerprint string")
    assert rows(lifecycle.match_moved(new, gone)) == [(2, "y/late", "y/back")]


def test_forget(spark, rows, now):
    projects = known(
        spark,
        ("y/a", "a", "missing", 1, OLD, None),
        ("y/b", "b", "sealed", 1, None, None),
        ("y/c", "c", "missing", 1, OLD, None),
    )
    work = spark.createDataFrame([(0, "done"), (2, "running"), (1, "done")],
                                 "project_id int, state string")
    asked = lifecycle.forgettable(projects, projects, work)
    gone = asked.where("refused is null")
    assert rows(gone, "id") == [(0,)]
    assert rows(lifecycle.forget(work, gone), "project_id") == [(1,), (2,)]
    assert lifecycle.forget_trace(gone, now).first().msg == "retired y/a (history mirror deleted)"


def test_rename_keeps_the_id(spark, rows):
    projects = known(spark, ("y/a", "a", "sealed", 1, None, None))
    moved = spark.createDataFrame([(0, "z/b c")], "id int, new_path string")
    out = lifecycle.rename_project(projects, moved)
    assert rows(out, "id", "rel_path", "name") == [(0, "z/b c", "b c")]


def test_scan_summary_counts(spark):
    projects = known(
        spark,
        ("y/a", "a", "sealed", 1, None, None),
        ("y/b", "b", "missing", 1, OLD, None),
        ("y/c", "c", "ignored", 1, None, None),
        ("y/d", "d", "sealed", 1, None, None),
    )
    found = listing(spark, "y/a", "y/b", "y/c", "y/new")
    got = lifecycle.scan_summary(found, projects).first().asDict()
    assert got == {"discovered": 4, "new": 1, "missing": 1, "reappeared": 1, "moved": 0,
                   "scanned": 3, "enqueued": 0, "errors": 0}
