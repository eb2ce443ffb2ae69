"""A whole scan over one small archive that holds every kind of event."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake.config import ArchiveConfig
from keepsake.operators.lifecycle import ArchiveUnavailable
from keepsake.plans.scan import PROJECT_COLUMNS, scan_archive

NOW, OLD = datetime(2024, 6, 1), datetime(2024, 1, 1)
KNOWN = (
    "id bigint, rel_path string, name string, state string, review_reason string, error string,"
    " preexisting boolean, last_generation_no int, first_seen timestamp, last_scan_at timestamp,"
    " last_change_at timestamp, stable_since timestamp, file_count bigint, total_bytes bigint,"
    " missing_since timestamp, state_before_missing string"
)
LISTING = "path string, kind string, size bigint, mtime_ns bigint, error string"
STAT = "id bigint, rel_path string, size bigint, mtime_ns bigint"
ITEM = (
    "id bigint, rel_path string, change string, old_size bigint, new_size bigint,"
    " old_mtime_ns bigint, new_mtime_ns bigint"
)


def project(number, path, state, sealed=True, **other):
    row = dict.fromkeys(PROJECT_COLUMNS)
    row |= {"id": number, "rel_path": path, "name": path.split("/")[-1], "state": state,
            "preexisting": False, "last_generation_no": 1 if sealed else None, "first_seen": OLD}
    row |= other
    return tuple(row[c] for c in PROJECT_COLUMNS)


def scan(spark, listed, known, sealed=(), previous=(), items=(), chains=(), kept=()):
    listing = spark.createDataFrame(
        [(p, *(r or ("file", 1, 1, None))) for p, r in listed.items()], LISTING)
    return scan_archive(
        listing,
        spark.createDataFrame(list(known), KNOWN),
        spark.createDataFrame([(i, p, 1, 1) for i, p in sealed], STAT),
        spark.createDataFrame([(i, p, 1, 1) for i, p in previous], STAT),
        spark.createDataFrame(list(items), ITEM),
        spark.createDataFrame(list(chains), "rel_path string, fingerprint string"),
        spark.createDataFrame(list(kept), "id bigint, fingerprint string"),
        F.lit(NOW), 10**18, ArchiveConfig(settle_hours=1),
    )


@pytest.mark.usefixtures("many_segments")
def test_every_event(spark, rows):
    listed = dict.fromkeys([
        "y/same/a", "y/more/a", "y/more/b", "y/less/b", "y/back/a", "y/fresh/a", "y/renamed/a",
        "y/draft/a", "y/ignored/z", "y/empty/.DS_Store", "y/shell/ascmhl/1.mhl", "y/held/a",
    ])
    listed["y/bad/a"] = ("other", 0, 0, "Permission denied")
    listed["z"] = ("folder", 0, 0, "Input/output error")
    known = [
        project(1, "y/same", "sealed"), project(2, "y/more", "sealed"),
        project(3, "y/less", "sealed"), project(4, "y/back", "missing", missing_since=OLD,
                                                state_before_missing="sealed"),
        project(5, "y/old name", "queued"), project(6, "y/lost", "hashing"),
        project(7, "z/hidden", "sealed"), project(8, "y/draft", "unsealed", sealed=False),
        project(9, "y/ignored", "ignored"), project(10, "y/empty", "changed"),
        project(11, "y/bad", "sealed", review_reason="kept"),
        project(12, "y/held", "needs_review", review_reason="legacy"),
        project(13, "y/long gone", "missing", missing_since=OLD, state_before_missing="changed"),
    ]
    sealed = [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "a"), (5, "a"), (10, "a"), (11, "a"),
              (12, "a")]
    previous = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (8, "a")]
    items = [(12, "origin.mov", "modified", None, 1, None, 1), (1, "stale", "deleted", 1, None, 1, None)]
    out = scan(spark, listed, known, sealed, previous, items,
               chains=[("y/renamed", "chain")], kept=[(5, "chain"), (6, "other")])
    states = dict(rows(out.projects, "rel_path", "state"))
    assert states == {
        "y/same": "sealed", "y/more": "queued", "y/less": "needs_review", "y/back": "sealed",
        "y/renamed": "sealed", "y/lost": "missing", "z/hidden": "sealed", "y/draft": "queued",
        "y/ignored": "ignored", "y/empty": "missing", "y/bad": "error", "y/held": "needs_review",
        "y/long gone": "missing", "y/fresh": "unsealed",
    }
    by_path = {r.rel_path: r for r in out.projects.collect()}
    assert (by_path["y/renamed"].id, by_path["y/renamed"].name) == (5, "renamed")
    assert by_path["y/fresh"].id == 14 and by_path["y/fresh"].first_seen == NOW
    lost = by_path["y/lost"]
    assert (lost.missing_since, lost.state_before_missing) == (NOW, "sealed")
    assert by_path["y/long gone"].missing_since == OLD
    assert by_path["y/back"].missing_since is None
    assert by_path["y/empty"].state_before_missing == "changed"
    assert by_path["y/bad"].review_reason == "kept"
    assert by_path["y/bad"].error == "scan errors: a: Permission denied"
    assert by_path["y/less"].review_reason == "1 deleted since the last seal: a"
    assert (by_path["y/more"].file_count, by_path["y/more"].stable_since) == (2, NOW)
    assert by_path["y/held"].review_reason == "legacy"
    assert rows(out.work) == sorted([(4, "verify"), (2, "append"), (8, "seal")], key=repr)
    assert rows(out.review_items, "id", "rel_path") == [(12, "origin.mov"), (3, "a")]
    assert out.summary.first().asDict() == {
        "discovered": 11, "new": 1, "missing": 2, "reappeared": 1, "moved": 1, "scanned": 10,
        "enqueued": 3, "errors": 1,
    }


def test_an_unmounted_archive_changes_nothing(spark):
    with pytest.raises(ArchiveUnavailable):
        scan(spark, {}, [project(1, "y/a", "sealed")])


def test_scanning_twice_settles(spark, rows):
    listed = dict.fromkeys(["y/a/f", "y/b/f"])
    first = scan(spark, listed, [])
    assert rows(first.projects, "rel_path", "state") == [("y/a", "unsealed"), ("y/b", "unsealed")]
    known = [tuple(r[c] for c in PROJECT_COLUMNS) for r in first.projects.collect()]
    previous = [(r.id, r.rel_path) for r in first.files.collect()]
    second = scan(spark, listed, known, previous=previous)
    assert rows(second.work, "kind") == [("seal",), ("seal",)]


def test_an_emptied_archive_loses_its_projects(spark, rows):
    known = [project(1, "y/a", "sealed"), project(2, "y/b", "unsealed", sealed=False)]
    listed = {"y/a": ("empty", 0, 0, None), "y/b/sub": ("empty", 0, 0, None)}
    out = scan(spark, listed, known)
    assert rows(out.projects, "rel_path", "state") == [("y/a", "missing"), ("y/b", "missing")]
