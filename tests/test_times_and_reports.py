"""Time predicates against the calendar, and the reports' texts."""

from datetime import UTC, datetime, time, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from keepsake.config import WorkingHours
from keepsake.functions import times
from keepsake.functions.text import human_size, short_digest
from keepsake.operators import reports

MADRID = "Europe/Madrid"
OFFICE = WorkingHours((0, 1, 2, 3, 4), "09:00", "20:00", MADRID)
NIGHT = WorkingHours((4,), "22:00", "06:00", MADRID)
GAP = WorkingHours((6,), "02:30", "05:00", MADRID)  # starts inside the hour skipped in March
BACK = WorkingHours((6,), "01:00", "02:30", MADRID)  # ends inside the hour repeated in October


def working(at, hours):
    local = at.replace(tzinfo=UTC).astimezone(ZoneInfo(hours.zone))
    start, end = (time.fromisoformat(t) for t in (hours.start, hours.end))
    wall = local.time()
    if start < end:
        return local.weekday() in hours.days and start <= wall < end
    return (local.weekday() in hours.days and wall >= start) or (
        (local.weekday() - 1) % 7 in hours.days and wall < end
    )


def instants():
    march = [datetime(2024, 3, 29, 0) + timedelta(minutes=37 * n) for n in range(160)]
    october = [datetime(2024, 10, 25, 0) + timedelta(minutes=37 * n) for n in range(160)]
    edges = [datetime(2024, 6, 3, 7), datetime(2024, 6, 3, 18), datetime(2024, 6, 3, 6, 59, 59)]
    return march + october + edges


@pytest.mark.parametrize("hours", [OFFICE, NIGHT, GAP, BACK])
def test_working_hours_and_next_change(spark, hours):
    df = spark.createDataFrame([(t,) for t in instants()], "t timestamp")
    got = df.select(
        "t", times.is_working(F.col("t"), hours).alias("on"),
        times.next_change(F.col("t"), hours).alias("next"),
    ).collect()
    for row in got:
        assert row.on == working(row.t, hours)
        want = row.t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        limit = row.t + timedelta(days=8)
        while working(want, hours) == row.on and want <= limit:
            want += timedelta(minutes=1)
        assert row.next == (want if want <= limit else None), row.t


def test_no_working_days_never_change(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp")
    never = WorkingHours((), "09:00", "20:00")
    assert df.select(times.next_change(F.col("t"), never)).first()[0] is None
    same = WorkingHours((0,), "09:00", "09:00")
    assert df.select(times.is_working(F.col("t"), same)).first()[0] is False


def test_iso(spark):
    df = spark.createDataFrame(
        [("2024-01-02T03:04:05.000006Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05",),
         ("nonsense",)], "s string")
    got = [r[0] for r in df.select(times.iso_text(times.parse_iso(F.col("s")))).collect()]
    assert got == ["2024-01-02T03:04:05.000006Z", "2024-01-02T01:04:05.000000Z",
                   "2024-01-02T03:04:05.000000Z", None]


def test_when_text(spark):
    now = F.lit(datetime(2024, 6, 3, 12))
    df = spark.createDataFrame(
        [(datetime(2024, 6, 3, 1, 2),), (datetime(2024, 5, 31, 7),), (datetime(2024, 1, 1),), (None,)],
        "t timestamp")
    got = [r[0] for r in df.select(times.when_text(F.col("t"), MADRID, now)).collect()]
    assert got == ["03:02", "Fri 09:00", "2024-01-01 01:00", ""]


@pytest.mark.parametrize("size", [0, 1, 999, 1000, 1150, 1250, 2250, 999_949, 999_950, 999_999,
                                  1_000_000, 28_412_345_678, 10**15, 5 * 10**18, None])
def test_human_size(spark, size):
    def plain(n):
        if n is None:
            return "-"
        value = float(n)
        for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
            if abs(value) < 1000 or unit == "PB":
                return f"{int(value)} {unit}" if unit == "B" else f"{value:.1f} {unit}"
            value /= 1000
        return ""

    df = spark.createDataFrame([(size,)], "n bigint")
    assert df.select(human_size(F.col("n"))).first()[0] == plain(size)


def test_short_digest(spark):
    df = spark.createDataFrame([("0123456789abcdef",), ("0123456789ab",), ("",), (None,)], "d string")
    got = [r[0] for r in df.select(short_digest(F.col("d"))).collect()]
    assert got == ["0123…cdef", "0123456789ab", "-", "-"]


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(
        [("p", "01_MASTERS/a.mov", 3000, "d" * 32), ("p", "01_MASTERS/sub/b.MOV", 1000, "e" * 8),
         ("p", "02_AUDIO/c.wav", 2000, None), ("p", "notes", 10, "f" * 8),
         ("p", "ascmhl/0001_x.mhl", 99, None)],
        "project string, rel_path string, size bigint, digest string",
    )


def test_content_panel(panel):
    folders = [tuple(r)[1:] for r in reports.folder_usage(panel).collect()]
    assert folders == [("(project root)", 1, 10, 0), ("01_MASTERS", 2, 4000, 100),
                       ("02_AUDIO", 1, 2000, 50)]
    assert reports.type_usage(panel).first().types == ".mov 2 · .wav 1 · no extension 1"
    assert reports.type_usage(panel, top=1).first().types == ".mov 2 · 2 others"
    listing = [(r.rel_path, r.size_text, r.digest_short) for r in reports.file_listing(panel).collect()]
    assert listing == [
        ("01_MASTERS/a.mov", "3.0 KB", "dddd…dddd"), ("01_MASTERS/sub/b.MOV", "1.0 KB", "e" * 8),
        ("02_AUDIO/c.wav", "2.0 KB", "-"), ("notes", "10 B", "f" * 8),
    ]


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([("p", "a/x", 1000), ("p", "b/x", 125), ("p", "c/x", 135)],
                               "project string, rel_path string, size bigint")
    got = {r.folder: r.percent for r in reports.folder_usage(df).collect()}
    assert got == {"a": 100, "b": 12, "c": 14}


def test_sentences(spark):
    def sentence(*states):
        df = spark.createDataFrame([(s,) for s in states], "state string")
        return reports.context_sentence(reports.state_counters(df)).first().sentence

    assert sentence() == "projects 0, to_decide 0, unsealed 0, in_queue 0, sealed 0, ignored 0"
    assert sentence("error", "sealed", "sealed", "changed", "ignored") == (
        "projects 4, to_decide 1, unsealed 0, in_queue 1, sealed 2, ignored 1"
    )


def test_board_order(spark):
    day = datetime(2024, 1, 1)
    rows = [
        (1, "y/b", "b", "sealed", day), (2, "y/a", "a", "sealed", day),
        (3, "y/c", "c", "sealed", day + timedelta(days=1)), (4, "y/d", "d", "sealed", None),
        (5, "y/e", "e", "changed", None), (6, "y/f", "f", "queued", None),
        (7, "y/g", "g", "hashing", None), (8, "y/z", "z", "error", None),
        (9, "y/h", "h", "needs_review", None),
    ]
    df = spark.createDataFrame(
        rows, "id int, rel_path string, name string, state string, last_sealed_at timestamp")
    board = reports.triage_board(df).orderBy("bucket", "position").collect()
    got = {}
    for r in board:
        got.setdefault(r.bucket, []).append(r.id)
    assert got == {"quiet": [3, 2, 1, 4], "moving": [7, 6, 5], "decide": [9, 8]}


def test_activity_tones(spark):
    day = datetime(2024, 1, 1)
    work = spark.createDataFrame(
        [(i, 1, k, "auto", s, 10, day + timedelta(hours=i), 1, 2, 0, 0) for i, (k, s) in enumerate(
            [("seal", "done"), ("verify", "done"), ("append", "failed"), ("seal", "cancelled"),
             ("seal", "running"), ("verify", "queued"), ("seal", "queued"), ("append", "queued")])],
        "id int, project_id int, kind string, trigger_kind string, state string, priority int,"
        " finished_at timestamp, files_done int, files_total int, bytes_done bigint,"
        " bytes_total bigint")
    log = spark.createDataFrame(
        [(1, 1, "start"), (1, 2, "needs review, nothing written: verification: 1 corrupt")],
        "job_id int, seq int, msg string")
    names = spark.createDataFrame([(1, "film")], "project_id int, name string")
    seen = F.lit(day)
    reviews = reports.review_of_work(log)
    out = reports.activity_log(work, seen, "UTC", reviews, names, limit=2)
    assert [r.when for r in out.collect()] == [
        "now", "next", "next", "next", "03:00", "02:00", "before"]
    got = [(r.tone, r.text, r.detail) for r in out.collect()]
    assert got == [
        ("running", "seal running: film", "1 of 2 files · 0 B of 0 B"),
        ("queued", "verify queued: film", ""),
        ("queued", "seal queued: film", ""),
        ("queued", "and 1 more", ""),
        ("cancelled", "cancelled, seal queued: film", ""),
        ("failed", "append failed: film", ""),
        ("older", "and 2 more", ""),
    ]
    trace = work.where("id = 0").withColumns({
        "kind": F.lit("retire"), "msg": F.lit("retired y/old film (history mirror deleted)"),
        "error": F.lit(None).cast("string")})
    gone = reports.activity_log(trace.withColumn("project_id", F.lit(None).cast("int")), seen).first()
    assert (gone.text, gone.detail) == ("removal done: old film", trace.first().msg)
    past = reports.activity_log(work, seen, "UTC", reviews, names, limit=9)
    done = {r.id: (r.tone, r.text, r.detail) for r in past.where("section = 2").collect()}
    assert done[1] == ("review", "verify found problems: film", "1 corrupt")
    assert done[0] == ("done", "seal done: film", "2 files · 0 B")
