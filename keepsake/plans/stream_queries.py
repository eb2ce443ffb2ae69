"""Streams over the given events and the archive views, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.config import ArchiveConfig
from keepsake.operators.running import number_rows
from keepsake.plans.fixtures import Fixtures
from keepsake.plans.registry import query
from keepsake.plans.report_queries import RESULTS, _results
from keepsake.plans.scan_queries import BOTH, DIFF, SETTLE_NOW_NS, THREE, now
from keepsake.schemas import TABLES
from keepsake.session import new_folder
from keepsake.sources.tables import TableSet
from keepsake.streaming import archives, streams


def _events(fx: Fixtures) -> DataFrame:
    """The given events as a stream; their zone-less times are UTC instants."""
    return (
        fx.spark.readStream.schema(TABLES["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(fx.sf_dir)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


CHANGES = """select user_id, event_id, ts, event_type as state, old_state
       from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as old_state
             from events)
       where event_type is distinct from old_state"""


def _states(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_id", "ts", F.col("event_type").alias("state"))


@query((), CHANGES)
def state_changes(fx: Fixtures) -> DataFrame:
    return streams.state_changes(_states(fx.table("events")), ["user_id"], ["ts", "event_id"])


@query((), CHANGES)
def state_change_stream(fx: Fixtures) -> DataFrame:
    out = new_folder(fx.spark, "changes")
    store = TableSet(fx.spark, new_folder(fx.spark, "states"))
    streams.run_available(
        streams.state_change_stream(
            _states(_events(fx)), store, out, new_folder(fx.spark, "offsets"), ["user_id"],
            ["ts", "event_id"],
        )
    )
    schema = "user_id bigint, event_id bigint, ts timestamp, state string, old_state string"
    return fx.spark.read.schema(schema).parquet(out).select(
        "user_id", "event_id", "ts", "state", "old_state"
    )


def _clock(fx: Fixtures) -> DataFrame:
    """A stream with one instant, two days after the last event."""
    path = new_folder(fx.spark, "clock")
    last = fx.table("events").agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    last.write.parquet(path)
    return fx.spark.readStream.schema("ts timestamp").parquet(path)


GAP_HOURS = 6
RUNS = f"""
stepped as (
  select *, case when ts - lag(ts) over w < interval {GAP_HOURS} hour then 0 else 1 end as opens
  from events window w as (partition by user_id order by ts, event_id)),
runs as (
  select user_id, min(ts) as started_at, max(ts) as last_change_at, count(*) as changes
  from (select *, sum(opens) over (partition by user_id order by ts, event_id) as run from stepped)
  group by user_id, run)"""


@query((), "select * from runs", ctes=RUNS)
def quiet_periods(fx: Fixtures) -> DataFrame:
    return streams.quiet_periods(
        fx.table("events"), ["user_id"], "ts", "event_id", GAP_HOURS * 3600
    )


@query(
    (),
    f"""select user_id, started_at, last_change_at,
               last_change_at + interval {GAP_HOURS} hour as settled_at, changes
        from runs""",
    ctes=RUNS,
)
def quiescence(fx: Fixtures) -> DataFrame:
    """Every run of changes, the last ones too: a clock goes on after the events."""
    out = new_folder(fx.spark, "quiet")
    rows = streams.quiescence(
        _events(fx), ["user_id"], "ts", f"{GAP_HOURS} hours", "1 hour", _clock(fx)
    )
    streams.run_available(streams.append_stream(rows, out, new_folder(fx.spark, "offsets")))
    return fx.spark.read.schema(rows.schema).parquet(out)


@query(
    (),
    """select user_id, ts, files_done, files_total from (
         select user_id, ts, cast(floor(value) % 21 as bigint) as files_done, 20 as files_total,
                row_number() over (partition by user_id, epoch_us(ts) // 500000,
                    case cast(floor(value) % 21 as bigint) when 0 then 0 when 20 then 2 else 1 end
                  order by ts desc, cast(floor(value) % 21 as bigint) desc) as n
         from events)
       where n = 1""",
)
def progress_rollup(fx: Fixtures) -> DataFrame:
    out = new_folder(fx.spark, "progress")
    progress = _events(fx).select(
        "user_id",
        "ts",
        (F.floor("value") % 21).cast("bigint").alias("files_done"),
        F.lit(20).alias("files_total"),
    )
    rows = streams.progress_rollup(progress, ["user_id"], "ts", "1 minute", clock=_clock(fx))
    streams.run_available(streams.append_stream(rows, out, new_folder(fx.spark, "offsets")))
    return fx.spark.read.schema(rows.schema).parquet(out)


@query(
    (),
    """select event_id, event_type as kind, ts,
              case when event_type = 'error' then 'warning' else 'info' end as level,
              case when event_type = 'error' then 'scan errors: ' || event_id
                   else event_type || ' {"id":"' || event_id || '"}' end as msg
       from events""",
)
def event_log(fx: Fixtures) -> DataFrame:
    out = new_folder(fx.spark, "log")
    number = F.col("event_id").cast("string")
    payload = F.when(
        F.col("event_type") == "error",
        F.create_map(
            F.lit("level"), F.lit("warning"), F.lit("msg"),
            F.concat(F.lit("scan errors: "), number),
        ),
    ).otherwise(F.create_map(F.lit("id"), number))
    events = _events(fx).select(
        "event_id", F.col("event_type").alias("kind"), "ts", payload.alias("payload")
    )
    rows = streams.event_log(events).drop("payload")
    streams.run_available(streams.append_stream(rows, out, new_folder(fx.spark, "offsets")))
    return fx.spark.read.schema(rows.schema).parquet(out)


@query(
    BOTH,
    "select project as run, status, count(*) as files from results group by 1, 2",
    ctes=RESULTS,
)
def verify_count_stream(fx: Fixtures) -> DataFrame:
    landed = new_folder(fx.spark, "results")
    _results(fx).select(F.col("project").alias("run"), "rel_path", "status").write.parquet(landed)
    store = TableSet(fx.spark, new_folder(fx.spark, "counts"))
    results = fx.spark.readStream.schema("run string, rel_path string, status string").option(
        "maxFilesPerTrigger", 4
    ).parquet(landed)
    streams.run_available(
        streams.verify_count_stream(results, store, new_folder(fx.spark, "offsets"))
    )
    return store.read("verify_counts")


SCANNED = f"""
first_scan as (
  select project, bool_or(bad) as bad from (
    select coalesce(p.project, s.project) as project,
           s.rel_path is not null and (p.rel_path is null or p.size <> s.size
             or abs(p.mtime_ns - s.mtime_ns) > 1000000000) as bad
    from fx_previous p full join fx_sealed s on s.project = p.project and s.rel_path = p.rel_path)
  group by project),
second_scan as (
  select c.project, c.project in (select project from fx_sealed) as sealed, f.bad as was_bad,
         c.modified + c.deleted > 0 as bad, c.added > 0 as added,
         s.stable and {SETTLE_NOW_NS} - c.newest_mtime_ns >= 0 as settled
  from counts c join steady s on s.project = c.project join first_scan f on f.project = c.project)"""


@query(
    THREE,
    """select 'a' as archive_id, project,
              case when not sealed then 'unsealed' when was_bad or bad then 'needs_review'
                   when added and settled then 'queued' when added then 'changed' else 'sealed' end
                as state
       from second_scan""",
    ctes=DIFF + "," + SCANNED,
)
def scan_stream(fx: Fixtures) -> DataFrame:
    """Two snapshots land and are announced one after the other, then the first one again, late."""
    landed, announced = new_folder(fx.spark, "snapshots"), new_folder(fx.spark, "announced")
    none = F.lit(None).cast("string").alias("error")
    for number, view in ((1, "fx_previous"), (2, "fx_current")):
        fx[view].select(
            F.lit("a").alias("archive_id"), F.lit(number).cast("bigint").alias("scan_id"),
            "project", "rel_path", "size", "mtime_ns", none,
        ).write.mode("append").partitionBy("archive_id", "scan_id").parquet(landed)
    for number in (1, 2, 1):
        fx.spark.createDataFrame([("a", number)], "archive_id string, scan_id bigint").coalesce(
            1
        ).write.mode("append").parquet(announced)
    schema = (
        "project string, rel_path string, size bigint, mtime_ns bigint, error string,"
        " archive_id string, scan_id bigint"
    )
    sealed = fx["fx_sealed"].withColumn("archive_id", F.lit("a"))
    store = TableSet(fx.spark, new_folder(fx.spark, "scans"))
    scans = (
        fx.spark.readStream.schema("archive_id string, scan_id bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(announced)
    )
    streams.run_available(
        streams.scan_stream(
            scans, lambda: fx.spark.read.schema(schema).parquet(landed), sealed, store,
            new_folder(fx.spark, "offsets"), now(), SETTLE_NOW_NS, 0,
        )
    )
    return store.read("projects").select("archive_id", "project", "state")


ARCHIVES = f"""
once as (
  select project, bool_or(bad) as bad, bool_or(added) as added from (
    select coalesce(p.project, s.project) as project,
           s.rel_path is not null and (p.rel_path is null or p.size <> s.size
             or abs(p.mtime_ns - s.mtime_ns) > 1000000000) as bad,
           s.rel_path is null as added
    from fx_previous p full join fx_sealed s on s.project = p.project and s.rel_path = p.rel_path)
  group by project),
twice as (
  select project, case when not sealed then 'unsealed' when was_bad or bad then 'needs_review'
                       when added and settled then 'queued' when added then 'changed'
                       else 'sealed' end as state
  from second_scan)"""
LOST = "src3"


@query(
    THREE,
    f"""select 'a' as archive_id, project, state from twice
        union all
        select 'b', project, case when project = '{LOST}' then 'missing' else state end from twice
        union all
        select 'c', project,
               case when project not in (select project from fx_sealed) then 'unsealed'
                    when bad then 'needs_review' when added then 'changed' else 'sealed' end
        from once""",
    ctes=DIFF + "," + SCANNED + "," + ARCHIVES,
)
def scan_stream_archives(fx: Fixtures) -> DataFrame:
    """Three archives, two scans each: one as it is, one that lost a project, and one whose second
    listing is empty and so is refused. The first scans come again, late."""
    landed, announced = new_folder(fx.spark, "snapshots"), new_folder(fx.spark, "announced")
    names = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("archive_id")
    for number, view in ((1, "fx_previous"), (2, "fx_current")):
        rows = fx[view].select(
            names, F.lit(number).cast("bigint").alias("scan_id"),
            F.concat_ws("/", "project", "rel_path").alias("path"), F.lit("file").alias("kind"),
            "size", "mtime_ns", F.lit(None).cast("string").alias("error"), "project",
        )
        if number == 2:
            rows = rows.where(
                (F.col("archive_id") != "c")
                & ((F.col("archive_id") != "b") | (F.col("project") != LOST))
            )
        rows.drop("project").write.mode("append").partitionBy("archive_id", "scan_id").parquet(landed)
    for number in (1, 2, 1):
        fx.spark.createDataFrame(
            [(a, number) for a in "abc"], "archive_id string, scan_id bigint"
        ).coalesce(1).write.mode("append").parquet(announced)
    sealed = fx["fx_sealed"].select(names, "project", "rel_path", "size", "mtime_ns")
    paths = fx["fx_previous"].select("project", F.lit(False).alias("sealed")).unionByName(
        fx["fx_sealed"].select("project", F.lit(True).alias("sealed"))
    )
    known = paths.groupBy("project").agg(F.max("sealed").alias("sealed")).select(
        names, "project", "sealed"
    )
    store = TableSet(fx.spark, new_folder(fx.spark, "archives"))
    numbered = number_rows(known, [], ["archive_id", "project"], "id")
    columns = {
        "id": F.col("id").cast("bigint"),
        "rel_path": F.col("project"),
        "name": F.col("project"),
        "state": F.when(F.col("sealed"), "sealed").otherwise("unsealed"),
        "preexisting": F.lit(True),
        "last_generation_no": F.when(F.col("sealed"), 1),
        "first_seen": now(),
    }
    shape = fx.spark.createDataFrame([], archives.SCHEMAS["projects"])
    archives.seed(
        store,
        {
            "projects": numbered.select(
                *[
                    columns.get(c, F.col(c) if c == "archive_id" else F.lit(None)).cast(t).alias(c)
                    for c, t in shape.dtypes
                ]
            )
        },
        now(),
    )
    scans = (
        fx.spark.readStream.schema("archive_id string, scan_id bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(announced)
    )
    schema = (
        "path string, kind string, size bigint, mtime_ns bigint, error string,"
        " archive_id string, scan_id bigint"
    )
    streams.run_available(
        archives.archive_scan_stream(
            scans, lambda: fx.spark.read.schema(schema).parquet(landed), sealed, store,
            new_folder(fx.spark, "offsets"), now(), SETTLE_NOW_NS,
            ArchiveConfig(project_depth=0, settle_hours=0),
        )
    )
    return archives.current(store, "projects").select(
        "archive_id", F.col("rel_path").alias("project"), "state"
    )
