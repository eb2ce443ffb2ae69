"""Streams over several batches against the batch form."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.sources.tables import TableSet
from keepsake.streaming import streams

START = datetime(2024, 1, 1)
EVENT = "project string, seq int, ts timestamp, state string"


@pytest.fixture
def landed(spark, tmp_path):
    """Three files of events in time order, one project far busier than the others."""
    path = str(tmp_path / "events")
    rows = [
        ("hot" if i % 3 else f"p{i % 4}", i, START + timedelta(minutes=i), "ab"[(i // 5) % 2])
        for i in range(300)
    ]
    for part in range(3):
        chunk = spark.createDataFrame(rows[part * 100 : (part + 1) * 100], EVENT)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.usefixtures("many_segments")
def test_state_changes_in_batches_equal_one_pass(spark, tmp_path, landed, rows):
    store = TableSet(spark, str(tmp_path / "store"))
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    for _ in range(2):  # the second run finds nothing new
        streams.run_available(streams.state_change_stream(
            read(spark, landed), store, out, offsets, ["project"], ["ts", "seq"]))
    whole = streams.state_changes(spark.read.schema(EVENT).parquet(landed), ["project"], ["ts", "seq"])
    columns = ("project", "seq", "state", "old_state")
    assert rows(spark.read.parquet(out), *columns) == rows(whole, *columns)


@pytest.mark.usefixtures("many_segments")
def test_quiet_periods(spark, rows):
    minutes = [0, 1, 2, 63, 64, 200]
    df = spark.createDataFrame(
        [("p", i, START + timedelta(minutes=m)) for i, m in enumerate(minutes)],
        "project string, seq int, ts timestamp")
    out = streams.quiet_periods(df, ["project"], "ts", "seq", 3600)
    got = [(r.started_at, r.changes) for r in out.orderBy("started_at").collect()]
    assert got == [(START, 3), (START + timedelta(minutes=63), 2), (START + timedelta(minutes=200), 1)]


def test_quiescence_stream_waits_for_the_watermark(spark, tmp_path, landed):
    out = str(tmp_path / "quiet")
    rows = streams.quiescence(read(spark, landed), ["project"], "ts", "10 minutes", "1 minute")
    streams.run_available(streams.append_stream(rows, out, str(tmp_path / "offsets")))
    got = spark.read.schema(rows.schema).parquet(out)
    last = START + timedelta(minutes=299)
    assert got.count() > 0
    assert got.where(F.col("settled_at") > F.lit(last - timedelta(minutes=1))).count() == 0


def test_progress_keeps_first_and_last(spark, tmp_path, rows):
    path = str(tmp_path / "progress")
    data = [("i", n, 10, START + timedelta(milliseconds=100 * n)) for n in range(11)]
    data.append(("z", 5, 10, START + timedelta(hours=1)))  # moves the watermark
    spark.createDataFrame(data, "item string, files_done int, files_total int, ts timestamp").coalesce(
        1).write.parquet(path)
    stream = spark.readStream.schema(
        "item string, files_done int, files_total int, ts timestamp").parquet(path)
    out = str(tmp_path / "out")
    kept = streams.progress_rollup(stream, ["item"], "ts", "1 second")
    streams.run_available(streams.append_stream(kept, out, str(tmp_path / "offsets")))
    assert rows(spark.read.parquet(out), "files_done") == [(0,), (10,), (4,), (9,)]


SNAPSHOT = (
    "project string, rel_path string, size bigint, mtime_ns bigint, error string,"
    " archive_id string, scan_id bigint"
)


def test_scans_apply_once_and_in_order(spark, tmp_path, rows):
    """A project appears, changes, settles and vanishes over four scans; replays change nothing."""
    landed = str(tmp_path / "snapshots")
    first = [("p", "a", 1, 1, None), ("q", "a", 1, 1, None)]
    second = [*first, ("p", "b", 1, 1, None), ("new", "a", 1, 1, None)]
    broken = [*second[:3], ("new", "x", 0, 0, "Permission denied")]
    scans = {1: first, 2: second, 3: second, 4: broken, 5: [r for r in second if r[0] != "q"]}
    for number, files in scans.items():
        spark.createDataFrame([(*f, "a", number) for f in files], SNAPSHOT).write.mode(
            "append").partitionBy("archive_id", "scan_id").parquet(landed)
    sealed = spark.createDataFrame(
        [("a", "p", "a", 1, 1), ("a", "q", "a", 1, 1)],
        "archive_id string, project string, rel_path string, size bigint, mtime_ns bigint")
    store = TableSet(spark, str(tmp_path / "store"))

    def apply(*numbers):
        asked = spark.createDataFrame([("a", n) for n in numbers],
                                      "archive_id string, scan_id bigint")
        snapshots = spark.read.schema(SNAPSHOT).parquet(landed)
        streams.apply_scans(asked, snapshots, sealed, store, F.lit(START), 10**18, 1)
        return dict(rows(store.read("projects"), "project", "state"))

    assert apply(1) == {"p": "sealed", "q": "sealed"}
    assert apply(2) == {"p": "changed", "q": "sealed", "new": "unsealed"}
    assert apply(2, 1) == {"p": "changed", "q": "sealed", "new": "unsealed"}
    assert apply(3) == {"p": "queued", "q": "sealed", "new": "queued"}
    assert rows(store.read("work"), "project", "kind") == [("new", "seal"), ("p", "append")]
    after = apply(4)
    assert after["new"] == "error" and after["p"] == "queued"
    assert apply(5)["q"] == "missing"
