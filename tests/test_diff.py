"""Snapshot diff and classification on the smallest rows that show each rule."""

import pytest
from pyspark.sql import functions as F

from keepsake.operators import diff

STAT = "project string, rel_path string, size bigint, mtime_ns bigint"
SECOND = 1_000_000_000


def snapshot(spark, *files, project="p"):
    return spark.createDataFrame([(project, *f) for f in files], STAT)


@pytest.fixture
def pair(spark):
    sealed = snapshot(
        spark,
        ("same", 1, 10 * SECOND),
        ("resized", 1, 10 * SECOND),
        ("touched", 1, 10 * SECOND),
        ("jitter", 1, 10 * SECOND),
        ("gone", 1, 10 * SECOND),
    )
    current = snapshot(
        spark,
        ("same", 1, 10 * SECOND),
        ("resized", 2, 10 * SECOND),
        ("touched", 1, 12 * SECOND),
        ("jitter", 1, 11 * SECOND),
        ("new", 1, 10 * SECOND),
    )
    return current, sealed


def test_changes(pair, rows):
    got = dict(rows(diff.diff_against_sealed(*pair), "rel_path", "change"))
    assert got == {
        "same": "unchanged",
        "resized": "modified",
        "touched": "modified",
        "jitter": "unchanged",
        "gone": "deleted",
        "new": "added",
    }


def test_one_nanosecond_over_the_tolerance(spark, rows):
    old = snapshot(spark, ("f", 1, 0))
    new = snapshot(spark, ("f", 1, SECOND + 1))
    assert rows(diff.diff_against_sealed(new, old), "change") == [("modified",)]


def test_self_diff_is_empty_and_sides_swap(pair, rows):
    current, sealed = pair
    assert rows(diff.diff_against_sealed(current, current).where("change <> 'unchanged'")) == []
    forth = diff.diff_against_sealed(current, sealed)
    back = diff.diff_against_sealed(sealed, current)
    added = rows(forth.where("change = 'added'"), "rel_path")
    assert added == rows(back.where("change = 'deleted'"), "rel_path")


def test_summary_agrees_with_rows(pair):
    current, sealed = pair
    got = diff.diff_summary(current, sealed, current).first()
    assert (got.added, got.modified, got.deleted, got.unchanged) == (1, 2, 1, 2)
    assert (got.files, got.total_bytes, got.newest_mtime_ns) == (5, 6, 12 * SECOND)
    assert got.stable


@pytest.mark.parametrize(
    ("current", "previous", "stable"),
    [
        ([("a", 1, 1)], [("a", 1, 1)], True),
        ([("a", 1, 1)], [], False),
        ([("a", 1, 1)], [("a", 1, 2)], False),
        ([("a", 1, 1)], [("a", 1, 1), ("b", 1, 1)], False),
        ([("a", 1, 1), ("b", 1, 1)], [("a", 1, 1)], False),
        ([], [], True),
    ],
)
def test_stability(spark, current, previous, stable):
    scanned = spark.createDataFrame([("p",)], "project string")
    got = diff.stability(snapshot(spark, *current), snapshot(spark, *previous), scanned)
    assert got.first().stable is stable


def test_never_scanned_is_not_stable(spark):
    current = snapshot(spark, ("a", 1, 1))
    assert diff.stability(current, current.limit(0)).first().stable is False


@pytest.mark.parametrize(
    ("age_ns", "stable", "settled"),
    [
        (168 * 3600 * SECOND, True, True),
        (168 * 3600 * SECOND - 1, True, False),
        (400 * 3600 * SECOND, False, False),
    ],
)
def test_settled(spark, age_ns, stable, settled):
    now = 10**18
    df = spark.createDataFrame([(stable, now - age_ns)], "stable boolean, newest_mtime_ns bigint")
    assert diff.settled(df, now, 168).first().settled is settled


CASES = [
    # state, sealed, added, modified, deleted, expected
    ("ignored", True, 1, 1, 1, "ignored"),
    ("queued", False, 1, 0, 0, "queued"),
    ("hashing", True, 0, 1, 0, "hashing"),
    ("needs_review", True, 0, 0, 0, "needs_review"),
    ("unsealed", False, 3, 0, 0, "unsealed"),
    ("error", False, 0, 0, 0, "unsealed"),
    ("sealed", True, 0, 0, 0, "sealed"),
    ("sealed", True, 1, 0, 0, "changed"),
    ("sealed", True, 0, 1, 0, "needs_review"),
    ("sealed", True, 0, 0, 1, "needs_review"),
    ("changed", True, 1, 0, 1, "needs_review"),
    ("changed", True, 0, 0, 0, "sealed"),
    ("error", True, 0, 0, 0, "sealed"),
    ("error", True, 1, 0, 0, "changed"),
]


def test_classify_matrix(spark):
    projects = spark.createDataFrame(
        [(f"p{i:02}", c[0], None, 1 if c[1] else None) for i, c in enumerate(CASES)],
        "project string, state string, review_reason string, last_generation_no int",
    )
    summary = spark.createDataFrame(
        [(f"p{i:02}", *c[2:5]) for i, c in enumerate(CASES)],
        "project string, added bigint, modified bigint, deleted bigint",
    )
    got = {r.project: r.new_state for r in diff.classify(projects, summary).collect()}
    assert got == {f"p{i:02}": c[5] for i, c in enumerate(CASES)}


def test_review_reason_lists_ten_paths(spark):
    sealed = snapshot(spark, *[(f"f{i:02}", 1, 1) for i in range(13)])
    rows = diff.diff_against_sealed(sealed.limit(0), sealed)
    reason = diff.review_reason(rows).first().review_reason
    listed = ", ".join(f"f{i:02}" for i in range(10))
    assert reason == f"13 deleted since the last seal: {listed} (+3 more)"


def test_review_items_keep_stored_when_diff_is_empty(spark, rows):
    same = snapshot(spark, ("a", 1, 1))
    stored = spark.createDataFrame(
        [("p", "legacy.mov", "modified", None, 5, None, 6)],
        "project string, rel_path string, change string, old_size bigint, new_size bigint,"
        " old_mtime_ns bigint, new_mtime_ns bigint",
    )
    kept = diff.review_items(diff.diff_against_sealed(same, same), stored)
    assert rows(kept, "rel_path") == [("legacy.mov",)]
    renewed = diff.review_items(diff.diff_against_sealed(same.limit(0), same), stored)
    assert rows(renewed, "rel_path") == [("a",)]


@pytest.mark.parametrize(
    ("state", "preexisting", "settled", "work"),
    [
        ("unsealed", False, True, "seal"),
        ("unsealed", True, True, None),
        ("unsealed", False, False, None),
        ("changed", True, True, "append"),
        ("changed", False, False, None),
        ("sealed", False, True, None),
        ("needs_review", False, True, None),
    ],
)
def test_auto_work(spark, state, preexisting, settled, work):
    df = spark.createDataFrame(
        [(state, preexisting, settled)], "state string, preexisting boolean, settled boolean"
    )
    assert diff.auto_work(df).first().work == work


def test_unsealed_files_have_no_tolerance(spark, rows):
    sealed = snapshot(spark, ("same", 1, 1), ("nudged", 1, 1))
    current = snapshot(spark, ("same", 1, 1), ("nudged", 1, 2), ("new", 1, 1))
    assert rows(diff.unsealed_files(current, sealed), "rel_path") == [("new",), ("nudged",)]


def test_bucketed_snapshots_need_no_shuffle(spark, tmp_path):
    from keepsake.sources.tables import write_bucketed

    df = spark.range(1000).select(
        F.lit("p").alias("project"),
        F.col("id").cast("string").alias("rel_path"),
        F.col("id").alias("size"),
        F.col("id").alias("mtime_ns"),
    )
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        sides = [
            write_bucketed(df, f"snapshot_{n}", str(tmp_path / n), 4) for n in ("one", "two")
        ]
        out = diff.diff_against_sealed(*sides)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.where("change = 'unchanged'").count() == 1000
    finally:
        spark.conf.set(threshold, before)


def test_diff_with_a_hot_project(spark):
    """One project holds two thirds of the files; it is spread by path."""
    project = F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 50)).otherwise("hot")
    sealed = spark.range(30_000).select(
        project.alias("project"), F.col("id").cast("string").alias("rel_path"),
        F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"),
    )
    current = sealed.where("cast(rel_path as int) % 10 <> 1")
    counts = diff.diff_summary(current, sealed).agg(F.sum("deleted"), F.sum("unchanged")).first()
    assert tuple(counts) == (3000, 27_000)


def exchanges(df):
    """Keys of the hash shuffles in the plan."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_file_rows_are_never_shuffled_by_project(spark, tmp_path):
    """Every shuffle of file rows has the path in its key, whatever Spark broadcasts."""
    from keepsake.operators import generations, verify

    path = str(tmp_path / "files")
    spark.range(100).select(
        F.lit("p").alias("project"),
        F.col("id").cast("string").alias("rel_path"),
        F.col("id").alias("size"),
        F.col("id").alias("mtime_ns"),
        F.md5(F.col("id").cast("string")).alias("digest"),
        F.lit(1).alias("generation_no"),
        F.lit("md5").alias("fmt"),
    ).write.parquet(path)
    files = spark.read.parquet(path)
    given = files.select("project", "rel_path", "fmt", "digest")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for df in (
            diff.diff_against_sealed(files, files),
            diff.unsealed_files(files, files),
            verify.compare_for_verify(files, files),
            generations.assign_actions(given, files),
        ):
            assert exchanges(df) and all("rel_path" in keys for keys in exchanges(df))
        whole = files.select("project").distinct().select(
            "project", F.lit(1).alias("generation_no"), F.lit(True).alias("is_full")
        )
        state = generations.current_from_history(whole, files)
        first = state._jdf.queryExecution().executedPlan().toString().split("FileScan")[0]
        assert "rel_path" in first.rsplit("Exchange hashpartitioning(", 1)[1].split(")")[0]
    finally:
        spark.conf.set(threshold, before)
