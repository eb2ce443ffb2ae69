"""Scans of several archives as a stream give what the batch scan gives, archive by archive."""

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.config import ArchiveConfig
from keepsake.plans.scan import PROJECT_COLUMNS, scan_archive
from keepsake.sources.tables import TableSet
from keepsake.streaming import archives, streams

NOW = datetime(2024, 6, 1)
LISTING = "path string, kind string, size bigint, mtime_ns bigint, error string"
SNAPSHOT = f"archive_id string, scan_id bigint, {LISTING}"
CHAIN = "archive_id string, scan_id bigint, rel_path string, fingerprint string"
CONFIG = ArchiveConfig(settle_hours=1)

# What the archives list at each scan: projects appear, grow, are lost, return and move; an archive
# lists nothing once, and one archive has paths of the other.
SCANS = {
    ("a", 1): ["y/p/1", "y/q/1", "y/s/1"], ("b", 1): ["y/p/1", "y/r/1"],
    ("a", 2): ["y/p/1", "y/p/2", "y/q/1", "y/new/1"], ("b", 2): [],
    ("a", 3): ["y/p/1", "y/p/2", "y/new/1", "y/moved/1", "y/s/1"], ("b", 3): ["y/r/1"],
}
CHAINS = [("a", 1, "y/q", "of q"), ("a", 2, "y/q", "of q"), ("a", 3, "y/moved", "of q")]
BATCHES = [[("a", 1), ("b", 1)], [("a", 2)], [("b", 2), ("a", 1)], [("a", 3), ("b", 3)]]
#: Scans that a batch does not apply: an older one of the same archive.
LATE = {(2, "a", 1)}


def listing_of(files):
    return [(p, "file", 1, 1, None) for p in files]


def batch_states(spark, archive):
    """The batch scan, one archive at a time, each scan on what the one before left."""
    known = spark.createDataFrame([], archives.SCHEMAS["projects"]).drop("archive_id")
    previous = spark.createDataFrame([], archives.SCHEMAS["files"]).drop("archive_id")
    items = spark.createDataFrame([], archives.SCHEMAS["review_items"]).drop("archive_id")
    kept, work = {}, []
    sealed = spark.createDataFrame([], "id bigint, rel_path string, size bigint, mtime_ns bigint")
    for number in range(1, 4):
        files = SCANS[archive, number]
        if not files and not known.isEmpty():
            continue
        chains = [(p, f) for a, n, p, f in CHAINS if (a, n) == (archive, number)]
        out = scan_archive(
            spark.createDataFrame(listing_of(files), LISTING), known, sealed, previous, items,
            spark.createDataFrame(chains, "rel_path string, fingerprint string"),
            spark.createDataFrame(list(kept.items()), "id bigint, fingerprint string"),
            F.lit(NOW), 10**18, CONFIG, first_discovery=number == 1)
        rows = out.projects.collect()
        for path, fingerprint in chains:
            kept |= {r.id: fingerprint for r in rows if r.rel_path == path}
        paths = {r.id: r.rel_path for r in rows}
        work += [(number, paths[r.id], r.kind) for r in out.work.collect()]
        known = spark.createDataFrame([tuple(r[c] for c in PROJECT_COLUMNS) for r in rows], known.schema)
        previous = spark.createDataFrame(out.files.collect(), previous.schema)
        items = spark.createDataFrame(out.review_items.collect(), items.schema)
    columns = [c for c in PROJECT_COLUMNS if c != "id"]
    return sorted((tuple(r[c] for c in columns) for r in known.collect()), key=repr), sorted(work)


def test_stream_equals_batch(spark, tmp_path):
    landed, announced = str(tmp_path / "snapshots"), str(tmp_path / "announced")
    rows = [(a, n, *f) for (a, n), files in SCANS.items() for f in listing_of(files)]
    spark.createDataFrame(rows, SNAPSHOT).write.partitionBy("archive_id", "scan_id").parquet(landed)
    store = TableSet(spark, str(tmp_path / "store"))
    chains = spark.createDataFrame(CHAINS, CHAIN)
    sealed = spark.createDataFrame(
        [], "archive_id string, project string, rel_path string, size bigint, mtime_ns bigint")

    def snapshots():
        return spark.read.schema(SNAPSHOT).parquet(landed)

    for batch in BATCHES:
        spark.createDataFrame(batch, "archive_id string, scan_id bigint").coalesce(1).write.mode(
            "append").parquet(announced)
        stream = spark.readStream.schema("archive_id string, scan_id bigint").parquet(announced)
        streams.run_available(archives.archive_scan_stream(
            stream, snapshots, sealed, store, str(tmp_path / "offsets"), F.lit(NOW), 10**18, CONFIG,
            lambda: chains))
    applied = {(r.archive_id, r.scan_id) for r in store.read_all("applied").collect()}
    assert applied == {key for n, batch in enumerate(BATCHES) for key in batch if (n, *key) not in LATE}
    projects = archives.current(store, "projects")
    log = store.read_all("work").collect()
    assert len({r.id for r in projects.collect()}) == projects.count()
    for archive in ("a", "b"):
        states, work = batch_states(spark, archive)
        columns = [c for c in PROJECT_COLUMNS if c != "id"]
        own = projects.where(F.col("archive_id") == archive).collect()
        assert sorted((tuple(r[c] for c in columns) for r in own), key=repr) == states
        of_scan = {(r.id, r.scan_id): r.rel_path for r in store.read_all("projects").collect()}
        got = sorted((r.scan_id, of_scan[r.id, r.scan_id], r.kind) for r in log if r.archive_id == archive)
        assert got == work
    missing = projects.where("state = 'missing'").select("archive_id", "rel_path").collect()
    assert [tuple(r) for r in missing] == [("b", "y/p")]
    last = {(r.archive_id, r.rel_path) for r in projects.collect()}
    assert last == {("a", f"y/{n}") for n in ("p", "new", "moved", "s")} | {("b", "y/p"), ("b", "y/r")}
    shut = store.read_all("scan_log").where("unreachable").select("archive_id", "scan_id").collect()
    assert [tuple(r) for r in shut] == [("b", 2)]
    # A batch that comes again changes nothing.
    before = store._pointer().count()
    archives.apply_archive_scans(
        spark.createDataFrame([("a", 9)], "archive_id string, scan_id bigint"), snapshots(), sealed,
        store, "batch-0", F.lit(NOW), 10**18, CONFIG)
    assert store._pointer().count() == before
