"""Verification, planning, reports and time predicates over the archive views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.config import WorkingHours
from keepsake.functions import times
from keepsake.operators import diff, planning, reports, verify
from keepsake.operators.generations import references_stale
from keepsake.plans import jobs
from keepsake.plans.fixtures import NOW, Fixtures
from keepsake.plans.history_queries import REFERENCED, _md5_rows, _referenced
from keepsake.plans.registry import query
from keepsake.plans.scan_queries import BOTH, CLASSIFIED, DIFF, REASONS, THREE, _projects, now

ZONE = "Europe/Madrid"
DAYS = 90
NIGHT = WorkingHours(days=(0, 1, 2, 3, 4), start="22:00", end="06:00", zone=ZONE)
OFFICE = WorkingHours(days=(0, 1, 2, 3, 4), start="09:00", end="20:00", zone=ZONE)


def at_home(column: str) -> str:
    """SQL for the wall time of a UTC instant."""
    return f"timezone('{ZONE}', timezone('UTC', {column}))"


def size_sql(column: str) -> str:
    """SQL for a size in decimal units."""
    cases = [f"when abs({column}) < 1000 then {column} || ' B'"]
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        cases.append(
            f"when abs({column}) < 1e{3 * power + 3}"
            f" then printf('%.1f', {column} / 1e{3 * power}) || ' {unit}'"
        )
    return f"case when {column} is null then '-' {' '.join(cases)} end"


RESULTS = """
results as (
  select coalesce(c.project, s.project) as project, coalesce(c.rel_path, s.rel_path) as rel_path,
         s.size as old_size, s.mtime_ns as old_mtime_ns, s.digest as expected,
         c.size as new_size, c.mtime_ns as new_mtime_ns, c.digest as actual,
         case when c.rel_path is null then 'missing' when s.rel_path is null then 'added'
              when s.digest is null or s.digest = c.digest then 'ok'
              when s.size = c.size and abs(s.mtime_ns - c.mtime_ns) <= 1000000000 then 'corrupt'
              else 'modified' end as status
  from fx_sealed s full join fx_current c on c.project = s.project and c.rel_path = s.rel_path),
verify_reasons as (
  select project,
         'verification: ' || concat_ws(', ',
           case when count(*) filter (status = 'corrupt') > 0
                then count(*) filter (status = 'corrupt') || ' corrupt' end,
           case when count(*) filter (status = 'modified') > 0
                then count(*) filter (status = 'modified') || ' modified' end,
           case when count(*) filter (status = 'missing') > 0
                then count(*) filter (status = 'missing') || ' missing' end)
         || '; files: ' || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end
         as review_reason
  from (select *, row_number() over (partition by project order by rel_path) as n
        from results where status in ('corrupt', 'modified', 'missing'))
  group by project)"""


def _results(fx: Fixtures) -> DataFrame:
    return verify.compare_for_verify(fx["fx_sealed"], fx["fx_current"])


@query(BOTH, "select * from results", ctes=RESULTS)
def compare_for_verify(fx: Fixtures) -> DataFrame:
    return _results(fx)


@query(BOTH, "select * from verify_reasons", ctes=RESULTS)
def verify_reason(fx: Fixtures) -> DataFrame:
    return verify.verify_reason(_results(fx))


@query(
    BOTH,
    """select project, count(*) filter (status in ('corrupt', 'modified', 'missing')) as problems,
              count(*) filter (status = 'ok') as verified, count(*) filter (status = 'added') as added,
              case when count(*) filter (status in ('corrupt', 'modified', 'missing')) = 0
                   then 'sealed' else 'needs_review' end as state,
              count(*) filter (status in ('corrupt', 'modified', 'missing')) = 0 as writes_generation,
              count(*) filter (status in ('corrupt', 'modified', 'missing')) = 0 as stamps_verified
       from results group by project""",
    ctes=RESULTS,
)
def verify_outcome(fx: Fixtures) -> DataFrame:
    return verify.verify_outcome(_results(fx))


@query(
    BOTH,
    """select c.project, case when r.review_reason is null then 'sealed' else 'needs_review' end as state,
              r.review_reason, r.review_reason is null as writes_generation, count(*) as files,
              cast(sum(c.size) as bigint) as bytes, r.review_reason is null as stamps_verified
       from fx_current c left join verify_reasons r on r.project = c.project
       group by c.project, r.review_reason""",
    ctes=RESULTS,
)
def verify_projects(fx: Fixtures) -> DataFrame:
    history = _md5_rows(fx["fx_sealed"].where(F.col("digest").isNotNull())).withColumn(
        "generation_no", F.lit(1)
    )
    result, _ = jobs.verify_projects(fx["fx_sealed"], fx["fx_current"], history, "md5")
    return result.outcome


@query(BOTH, "select project, status, count(*) as files from results group by 1, 2", ctes=RESULTS)
def verify_counts(fx: Fixtures) -> DataFrame:
    return verify.verify_counts(_results(fx))


@query(
    BOTH,
    """select project, rel_path, case when status = 'missing' then 'deleted' else 'modified' end as change,
              old_size, new_size, old_mtime_ns, new_mtime_ns
       from results where status in ('corrupt', 'modified', 'missing')""",
    ctes=RESULTS,
)
def verify_review_items(fx: Fixtures) -> DataFrame:
    return verify.verify_review_items(_results(fx))


@query(
    BOTH,
    """select project, 2 as run, status,
              case status when 'corrupt' then 0 when 'modified' then 1 when 'missing' then 2 else 3 end
                as rank, rel_path, cast(1 as bigint) as files
       from results where project <> 'src5' and status <> 'ok'
       union all
       select project, case when project = 'src5' then 1 else 2 end, 'ok', 4, null,
              count(*) filter (project = 'src5' or status = 'ok')
       from results group by 1""",
    ctes=RESULTS,
)
def verify_report(fx: Fixtures) -> DataFrame:
    """Two runs; the second did not cover one project."""
    rows = _results(fx)
    first = rows.withColumns({"status": F.lit("ok"), "run": F.lit(1)})
    second = rows.where("project <> 'src5'").withColumn("run", F.lit(2))
    return verify.verify_report(first.unionByName(second))


@query(
    ("fx_projects", "fx_jobs"),
    """select p.id, case when p.last_generation_no is null
                           or p.state not in ('sealed', 'queued', 'hashing')
                         then 'verify skipped: project is ' || p.state end as skipped
       from fx_projects p where p.id in (select project_id from fx_jobs where kind = 'verify')""",
)
def verify_eligible(fx: Fixtures) -> DataFrame:
    asked = fx["fx_jobs"].where("kind = 'verify'").select(F.col("project_id").alias("id"))
    return verify.verify_eligible(fx["fx_projects"], asked.distinct()).select("id", "skipped")


DUE = f"""
due as (
  select id, rel_path, coalesce(last_verified_at, last_sealed_at, first_seen) as ref_at
  from fx_projects
  where state = 'sealed' and last_generation_no is not null
    and coalesce(last_verified_at, last_sealed_at, first_seen) <= {NOW} - interval {DAYS} day
    and id not in (select project_id from fx_jobs
                   where kind = 'verify' and state in ('queued', 'running'))),
picked as (
  select *, row_number() over (order by ref_at, rel_path) as position from due
  qualify position <= (select cast(ceil(count(*) / {DAYS}) as bigint) from fx_projects
                       where state = 'sealed' and last_generation_no is not null))"""
PLANNED = ("fx_projects", "fx_jobs")


@query(PLANNED, "select id, rel_path, ref_at from due", ctes=DUE)
def due_for_verification(fx: Fixtures) -> DataFrame:
    out = planning.due_for_verification(fx["fx_projects"], fx["fx_jobs"], now(), DAYS)
    return out.select("id", "rel_path", "ref_at")


@query(
    ("fx_projects",),
    f"""select count(*) as sealed, cast(ceil(count(*) / {DAYS}) as bigint) as cap from fx_projects
        where state = 'sealed' and last_generation_no is not null""",
)
def daily_cap(fx: Fixtures) -> DataFrame:
    return planning.daily_cap(fx["fx_projects"], DAYS)


@query(PLANNED, "select id, rel_path, ref_at, position from picked", ctes=DUE)
def stagger(fx: Fixtures) -> DataFrame:
    return planning.stagger(fx["fx_projects"], fx["fx_jobs"], now(), DAYS)


def _by_archive(fx: Fixtures) -> DataFrame:
    """Projects with the first folder of their path as archive."""
    return fx["fx_projects"].withColumn("archive_id", F.split("rel_path", "/")[0])


@query(
    PLANNED,
    f"""select archive_id, id, rel_path, ref_at, position from (
          select d.*, split_part(d.rel_path, '/', 1) as archive_id,
                 row_number() over (partition by split_part(d.rel_path, '/', 1)
                                    order by ref_at, d.rel_path) as position
          from due d)
        join (select split_part(rel_path, '/', 1) as archive_id,
                     cast(ceil(count(*) filter (state = 'sealed' and last_generation_no is not null)
                               / {DAYS}) as bigint) as cap
              from fx_projects group by 1) using (archive_id)
        where position <= cap""",
    ctes=DUE,
)
def stagger_archives(fx: Fixtures) -> DataFrame:
    """Each archive has its own daily cap."""
    return planning.stagger(_by_archive(fx), fx["fx_jobs"], now(), DAYS, by=("archive_id",))


NEXT = f"""
next as (
  select id, coalesce(last_verified_at, last_sealed_at) + interval {DAYS} day as due_at
  from fx_projects where state = 'sealed' and coalesce(last_verified_at, last_sealed_at) is not null)"""
NEXT_TEXT = f"""case when cast({at_home('due_at')} as date) < cast({at_home(NOW)} as date) then 'overdue'
              else strftime({at_home('due_at')}, '%Y-%m-%d') end"""


@query(("fx_projects",), f"select id, due_at, {NEXT_TEXT} as next_check from next", ctes=NEXT)
def next_verification(fx: Fixtures) -> DataFrame:
    out = planning.next_verification(fx["fx_projects"], now(), DAYS, ZONE)
    return out.select("id", "due_at", "next_check")


@query(
    ("fx_projects",),
    f"select due_at, {NEXT_TEXT} as next_check from (select min(due_at) as due_at from next)",
    ctes=NEXT,
)
def archive_next_verification(fx: Fixtures) -> DataFrame:
    return planning.archive_next_verification(fx["fx_projects"], now(), DAYS, ZONE)


@query(
    ("fx_projects", "fx_jobs", "fx_generations"),
    """select rel_path, 'verify' as kind from picked
       union all
       select '.', 'root_manifest' where exists (select 1 from referenced)""",
    ctes=DUE + "," + REFERENCED,
)
def plan_maintenance(fx: Fixtures) -> DataFrame:
    """No open refresh, and the flag of a stale root manifest is set."""
    verifications = planning.stagger(fx["fx_projects"], fx["fx_jobs"], now(), DAYS)
    stale = references_stale(_referenced(fx), fx["fx_projects"], True, True)
    work = fx["fx_jobs"].where("kind <> 'root_manifest'")
    return planning.plan_maintenance(verifications, stale, work)


PLAN = """
plan as (
  select r.id, r.kind, r.project_id, r.state,
         case when r.state = 'queued' and g.top is not null then 'manual' else r.trigger_kind end
           as trigger_kind,
         case when r.state = 'queued' and g.top is not null then greatest(r.priority, g.top)
              else r.priority end as priority,
         case when r.state = 'queued' and g.top is not null then r.bypass_hours or coalesce(g.bypass, false)
              else r.bypass_hours end as bypass_hours,
         r.created_at, g.requests
  from (select kind, project_id, min(id) as id, count(*) as requests,
               max(case when trigger_kind = 'manual' then priority end) as top,
               bool_or(trigger_kind = 'manual' and bypass_hours) as bypass
        from fx_requests where state in ('queued', 'running') group by 1, 2) g
  join fx_requests r on r.id = g.id)"""


def _plan(fx: Fixtures) -> DataFrame:
    return planning.work_plan(fx["fx_requests"].where("state in ('queued', 'running')"))


@query(
    ("fx_requests",),
    "select *, row_number() over (order by priority desc, created_at, id) as position from plan",
    ctes=PLAN,
)
def work_plan(fx: Fixtures) -> DataFrame:
    return _plan(fx)


@query(
    ("fx_requests",),
    "select id, kind, project_id from plan where state = 'queued' and bypass_hours",
    ctes=PLAN,
)
def outside_hours(fx: Fixtures) -> DataFrame:
    """Asked on a Monday noon, inside working hours."""
    out = planning.outside_hours(_plan(fx), now(), OFFICE)
    return out.select("id", "kind", "project_id")


DECIDED = """
waiting as (
  select p.id, j.* exclude (id, state, project_id, rn), j.id as work_id, j.state as work_state
  from fx_projects p join (
    select *, row_number() over (partition by project_id, state order by
                case when state = 'queued' then -priority else 0 end,
                case when state = 'queued' then created_at end,
                case when state = 'queued' then id else -id end) as rn
    from fx_requests where state in ('queued', 'running')) j
  on j.project_id = p.id and j.rn = 1
   and ((p.state = 'queued' and j.state = 'queued') or (p.state = 'hashing' and j.state = 'running'))),
ruled as (
  select d.id, d.action, p.state as old_state, p.last_generation_no is not null as has_history,
         w.work_id, w.kind as waits_for, w.work_state, w.trigger_kind, p.id % 2 = 0 as has_unsealed,
         case when d.action = 'cancel' then
                case when w.trigger_kind is distinct from 'manual'
                       or w.kind not in ('seal', 'append', 'accept_new_version', 'verify')
                     then 'nothing to cancel'
                     when w.work_state = 'running' then 'cancel a running job through its runner' end
              when d.action = 'start_now' then
                case when w.kind is null or w.kind not in ('seal', 'append', 'accept_new_version')
                     then 'nothing to start now'
                     when w.work_state = 'running' then 'start a running job through its runner' end
              when d.action = 'ignore' then
                case when p.state = 'hashing' then 'cannot ignore while hashing' end
              when d.action = 'unignore' then case when p.state <> 'ignored' then 'not ignored' end
              when (d.action = 'seal' and p.state = 'unsealed')
                or (d.action in ('accept', 'postpone') and p.state = 'needs_review')
                or (d.action = 'verify_now' and p.state in ('sealed', 'changed')
                    and p.last_generation_no is not null)
                or (d.action = 'update_now' and p.state = 'changed'
                    and p.last_generation_no is not null) then null
              else d.action || ' does not apply to state ' || p.state end as rejected
  from fx_decisions d join fx_projects p on p.id = d.id left join waiting w on w.id = d.id)"""


@query(
    ("fx_decisions", "fx_requests"),
    """select id, action, old_state,
              case when rejected is not null then old_state
                   when action = 'cancel' then
                     case when waits_for = 'verify' and has_unsealed then 'changed'
                          when waits_for = 'verify' then 'sealed' when waits_for = 'seal' then 'unsealed'
                          when waits_for = 'append' then 'changed' else 'needs_review' end
                   when action in ('start_now', 'postpone') then old_state
                   when action = 'ignore' then 'ignored'
                   when action = 'unignore' then case when has_history then 'sealed' else 'unsealed' end
                   else 'queued' end as new_state,
              case when rejected is null then case action when 'seal' then 'seal'
                when 'accept' then 'accept_new_version' when 'verify_now' then 'verify'
                when 'update_now' then 'append' end end as work_kind,
              case when rejected is null then case action when 'seal' then 130 when 'accept' then 130
                when 'verify_now' then 110 when 'update_now' then 120 end end as priority,
              case when rejected is null and action in ('cancel', 'start_now') then work_id end as work_id,
              rejected is null and action in ('verify_now', 'update_now', 'start_now') as bypass_hours,
              rejected
       from ruled""",
    ctes=DECIDED,
)
def apply_decisions(fx: Fixtures) -> DataFrame:
    projects = fx["fx_projects"]
    unsealed = projects.where("id % 2 = 0").select("id")
    return planning.apply_decisions(fx["fx_decisions"], projects, fx["fx_requests"], unsealed)


@query(
    ("fx_decisions", "fx_requests"),
    """select p.id, p.state, w.kind as work_kind,
              coalesce(w.trigger_kind = 'manual' and w.kind <> 'root_manifest', false) as cancellable,
              case when w.kind in ('seal', 'append', 'accept_new_version') and not w.bypass_hours
                   then case w.kind when 'seal' then 'Seal now' when 'append' then 'Update now'
                             else 'Accept now' end else '' end as start_now,
              p.state = 'changed' and p.last_generation_no is not null as update_now
       from fx_projects p left join waiting w on w.id = p.id
       where p.state in ('queued', 'hashing', 'changed')""",
    ctes=DECIDED,
)
def project_actions(fx: Fixtures) -> DataFrame:
    """Asked inside working hours."""
    return reports.project_actions(fx["fx_projects"], fx["fx_requests"], now(), OFFICE)


@query(
    PLANNED,
    """select j.id, j.kind, j.project_id,
              case when p.state is null then 'failed' when p.state = 'missing' or j.files_done <= 20
                     then 'cancelled'
                   when j.id % 7 = 0 or j.id % 5 = 0 then 'failed' else 'done' end as work_state,
              case when p.state is null then null when p.state = 'missing' or j.files_done <= 20
                     then 'missing'
                   when j.id % 7 = 0 or j.id % 5 = 0 then 'error' else 'sealed' end as new_state,
              case when p.state is null then 'project not found'
                   when p.state = 'missing' then 'skipped: project folder is missing'
                   when j.files_done <= 20 then 'the project folder has no files left'
                   when j.id % 7 = 0 then 'file kept changing while being read'
                   when j.id % 5 = 0 then 'read error' end as error
       from fx_jobs j left join fx_projects p on p.id = j.project_id
       where j.state = 'running'""",
)
def work_outcome(fx: Fixtures) -> DataFrame:
    items = fx["fx_jobs"].where("state = 'running'")
    read = items.where("files_done > 20").select(
        "id",
        F.explode(
            F.array(
                F.lit("ok"),
                F.when(F.col("id") % 7 == 0, "changed").otherwise("ok"),
                F.when(F.col("id") % 5 == 0, "error").otherwise("ok"),
            )
        ).alias("status"),
    )
    return planning.work_outcome(items, read, fx["fx_projects"])


# --- reports ---------------------------------------------------------------------------------

USAGE = """
usage as (
  select project, case when contains(rel_path, '/') then split_part(rel_path, '/', 1)
                       else '(project root)' end as folder,
         count(*) as files, cast(sum(size) as bigint) as bytes
  from fx_sealed group by 1, 2)"""


@query(
    ("fx_sealed",),
    """select project, folder, files, bytes,
              cast(round_even(bytes * 100.0 / max(bytes) over (partition by project), 0) as bigint)
                as percent
       from usage""",
    ctes=USAGE,
)
def folder_usage(fx: Fixtures) -> DataFrame:
    return reports.folder_usage(fx["fx_sealed"])


@query(
    ("fx_sealed",),
    """select project, count(*) as n_types,
              string_agg(type || ' ' || files, ' · ' order by n) filter (n <= 2)
              || case when count(*) > 2 then ' · ' || (count(*) - 2) || ' others' else '' end as types
       from (select *, row_number() over (partition by project order by files desc, type) as n
             from (select project, coalesce(nullif(lower(regexp_extract(split_part(rel_path, '/', -1),
                          '^.+([.][^.]+)$', 1)), ''), 'no extension') as type, count(*) as files
                   from fx_sealed group by 1, 2))
       group by project""",
)
def type_usage(fx: Fixtures) -> DataFrame:
    return reports.type_usage(fx["fx_sealed"], top=2)


TOTALS = f"""
dated as (
  select project, count(*) as files, cast(sum(size) as bigint) as bytes,
         timestamp '1998-01-01 23:30:00' + to_days(cast(substr(project, 4) as int) * 3) as sealed_at,
         case when cast(substr(project, 4) as int) % 2 = 0 then
           timestamp '1998-02-01 10:00:00' + to_days(cast(substr(project, 4) as int) * 3) end as verified_at
  from fx_sealed group by project),
checked as (
  select *, coalesce(verified_at, sealed_at) + interval {DAYS} day as due_at from dated)"""


@query(
    ("fx_sealed",),
    f"""select project, files, bytes,
               case when files = 1 then '1 file' else files || ' files' end || ' · ' || {size_sql('bytes')}
                 || ' · sealed ' || strftime({at_home('sealed_at')}, '%Y-%m-%d') as summary,
               case when verified_at is null then 'Not verified yet · first check '
                    else 'Last verified ' || strftime({at_home('verified_at')}, '%Y-%m-%d')
                         || ' · next check ' end
               || case when cast({at_home('due_at')} as date) < cast({at_home(NOW)} as date)
                       then 'is due now'
                       else 'around ' || strftime({at_home('due_at')}, '%Y-%m-%d') end as verified
        from checked""",
    ctes=TOTALS,
)
def archive_totals(fx: Fixtures) -> DataFrame:
    sealed = fx["fx_sealed"]
    number = F.expr("substring(project, 4)").cast("int")
    projects = sealed.select("project").distinct().select(
        "project",
        (F.expr("timestamp '1998-01-01 23:30:00'") + F.make_dt_interval(number * 3))
        .alias("last_sealed_at"),
        F.when(
            number % 2 == 0,
            F.expr("timestamp '1998-02-01 10:00:00'") + F.make_dt_interval(number * 3),
        ).alias("last_verified_at"),
    )
    return reports.archive_totals(sealed, projects, now(), DAYS, ZONE)


@query(
    ("fx_sealed",),
    f"""select project, rel_path, {size_sql('size')} as size_text,
               case when digest is null then '-'
                    else substr(digest, 1, 4) || '…' || right(digest, 4) end as digest_short,
               coalesce(digest, '') as digest
        from fx_sealed""",
)
def file_listing(fx: Fixtures) -> DataFrame:
    return reports.file_listing(fx["fx_sealed"])


COUNTS = """
counters as (
  select count(*) filter (state <> 'ignored') as projects,
         count(*) filter (state = 'needs_review') as needs_review,
         count(*) filter (state = 'unsealed') as unsealed, count(*) filter (state = 'error') as errors,
         count(*) filter (state = 'missing') as missing, count(*) filter (state = 'sealed') as sealed,
         count(*) filter (state = 'ignored') as ignored,
         count(*) filter (state in ('needs_review', 'error', 'missing')) as to_decide,
         count(*) filter (state in ('queued', 'hashing', 'changed')) as in_queue,
         (select count(*) from fx_jobs where state = 'queued') as queued_work
  from fx_projects)"""


@query(
    PLANNED,
    """select *, 'projects ' || projects || ', to_decide ' || to_decide || ', unsealed ' || unsealed
              || ', in_queue ' || in_queue || ', sealed ' || sealed || ', ignored ' || ignored as sentence
       from counters""",
    ctes=COUNTS,
)
def state_counters(fx: Fixtures) -> DataFrame:
    return reports.context_sentence(reports.state_counters(fx["fx_projects"], fx["fx_jobs"]))


@query(
    PLANNED,
    """select case when grouping(archive_id) = 0 then archive_id end as archive_id,
              cast(grouping(archive_id) as int) as level,
              count(*) filter (state not in ('ignored', 'queued work')) as projects,
              count(*) filter (state = 'queued work') as queued_work,
              count(*) filter (state = 'needs_review') as needs_review,
              count(*) filter (state = 'unsealed') as unsealed,
              count(*) filter (state = 'error') as errors,
              count(*) filter (state = 'missing') as missing,
              count(*) filter (state = 'sealed') as sealed,
              count(*) filter (state = 'ignored') as ignored,
              count(*) filter (state in ('needs_review', 'error', 'missing')) as to_decide,
              count(*) filter (state in ('queued', 'hashing', 'changed')) as in_queue
       from (select split_part(rel_path, '/', 1) as archive_id, state from fx_projects
             union all
             select split_part(p.rel_path, '/', 1), 'queued work' from fx_jobs j
             join fx_projects p on p.id = j.project_id where j.state = 'queued')
       group by rollup (archive_id)""",
)
def archive_counters(fx: Fixtures) -> DataFrame:
    """The counters of each archive and of all of them."""
    projects = _by_archive(fx)
    owners = projects.select("archive_id", F.col("id").alias("project_id"))
    work = fx["fx_jobs"].join(owners, "project_id")
    return reports.state_counters(projects, work, ("archive_id",), totals=True)


@query(
    ("fx_projects",),
    """select id, bucket, light, row_number() over (partition by bucket order by
                case when bucket <> 'moving' then 0 when state = 'hashing' then 0
                     when state = 'queued' then 1 else 2 end,
                bucket = 'quiet' and last_sealed_at is null,
                case when bucket = 'quiet' then last_sealed_at end desc nulls last,
                case when bucket in ('moving', 'quiet') then name else rel_path end, rel_path) as position
       from (select *, case when state in ('needs_review', 'error', 'missing') then 'decide'
                            when state = 'unsealed' then 'unsealed' when state = 'sealed' then 'quiet'
                            when state = 'ignored' then 'ignored' else 'moving' end as bucket,
                    case when state in ('needs_review', 'error', 'missing') then 'red'
                         when state = 'sealed' then 'green' when state = 'ignored' then 'grey'
                         else 'amber' end as light
             from fx_projects)""",
)
def triage_board(fx: Fixtures) -> DataFrame:
    return reports.triage_board(fx["fx_projects"]).select("id", "bucket", "light", "position")


@query(
    THREE,
    f"""select project, change, rel_path,
               case when change = 'modified' then concat_ws(', ',
                      case when old_size <> new_size
                           then 'size ' || {size_sql('old_size')} || ' → ' || {size_sql('new_size')} end,
                      strftime({at_home("make_timestamp(cast(new_mtime_ns // 1000 as bigint))")}, '%Y-%m-%d'))
                    when change = 'deleted' then '' else 'added files are fine' end as detail
        from diff where change in ('modified', 'deleted')
          or (change = 'added' and project in (select project from fx_sealed))""",
    ctes=DIFF,
)
def review_report(fx: Fixtures) -> DataFrame:
    rows = diff.diff_against_sealed(fx["fx_current"], fx["fx_sealed"])
    items = diff.review_items(rows)
    return reports.review_report(items, fx["fx_current"], fx["fx_sealed"], ZONE)


@query(
    ("fx_known", "fx_gen_files"),
    """select k.id, case when starts_with(k.review_reason, 'verification:')
                           then split_part(k.review_reason, ';', 1)
                         when i.m > 0 and i.d > 0 then i.m || ' modified, ' || i.d || ' deleted since the last seal'
                         when i.m > 0 then i.m || ' modified since the last seal'
                         when i.d > 0 then i.d || ' deleted since the last seal'
                         when k.review_reason <> '' then split_part(k.review_reason, ':', 1)
                         else 'something changed since the last seal' end as summary
       from fx_known k left join (
         select project_id, count(*) filter (starts_with(rel_path, 'd1/')) as m,
                count(*) filter (starts_with(rel_path, 'd2/')) as d
         from fx_gen_files where generation_no = 1 and project_id % 2 = 0 group by 1) i
       on i.project_id = k.id
       where k.state = 'needs_review'""",
)
def review_summary(fx: Fixtures) -> DataFrame:
    files = fx["fx_gen_files"].where("generation_no = 1 and project_id % 2 = 0")
    kind = F.when(F.col("rel_path").startswith("d1/"), "modified").when(
        F.col("rel_path").startswith("d2/"), "deleted"
    )
    items = files.select(F.col("project_id").alias("id"), kind.alias("change"))
    return reports.review_summary(fx["fx_known"], items)


@query(
    THREE,
    """select p.project, p.state,
              case when (p.state = 'changed' and p.last_generation_no is not null)
                     or p.work_kind = 'append' then coalesce(u.bytes, 0)
                   else p.total_bytes end as read_bytes
       from (select p.project, c.new_state as state, p.last_generation_no,
                    case when p.state = 'queued' then 'append' end as work_kind, n.total_bytes
             from projects p join classified c on c.project = p.project
             join counts n on n.project = p.project) p
       left join (
         select c.project, cast(sum(c.size) as bigint) as bytes from fx_current c
         where not exists (select 1 from fx_sealed s where s.project = c.project
           and s.rel_path = c.rel_path and s.size = c.size and s.mtime_ns = c.mtime_ns)
         group by 1) u on u.project = p.project""",
    ctes=DIFF + "," + REASONS + "," + CLASSIFIED,
)
def read_cost(fx: Fixtures) -> DataFrame:
    current, sealed = fx["fx_current"], fx["fx_sealed"]
    summary = diff.diff_summary(current, sealed)
    projects = diff.classify(_projects(fx), summary).join(
        summary.select("project", "total_bytes"), "project"
    )
    asked = projects.select(
        "project",
        F.col("new_state").alias("state"),
        "last_generation_no",
        "total_bytes",
        F.when(F.col("state") == "queued", "append").alias("work_kind"),
    )
    return reports.read_cost(asked, current, sealed).select("project", "state", "read_bytes")


@query(
    ("fx_projects",),
    "select state, file_count, total_bytes, last_sealed_at, rel_path from fx_projects",
)
def project_list(fx: Fixtures) -> DataFrame:
    return reports.project_list(fx["fx_projects"])


@query(
    ("fx_known",),
    f"""select id, rel_path, split_part(rel_path, '/', 1) as folder, state,
               case when state in ('needs_review', 'error', 'missing') then 'red'
                    when state = 'sealed' then 'green' when state = 'ignored' then 'grey'
                    else 'amber' end as light,
               case when state in ('needs_review', 'error', 'missing') then 0
                    when state = 'sealed' then 2 when state = 'ignored' then 3 else 1 end as severity,
               case state when 'unsealed' then 'no manifest' when 'changed' then 'new files'
                    when 'hashing' then 'reading files' when 'needs_review' then 'needs review'
                    else state end as label,
               case when state = 'sealed' then 'MHL OK' when state = 'needs_review' then 'MHL revisar'
                    when state not in ('missing', 'ignored') then 'MHL pendiente' end as tag,
               {size_sql('total_bytes')} as size_text, sealed_on, verified_on,
               case state
                 when 'sealed' then trim('sealed ' || sealed_on)
                   || case when verified_on <> '' then ' · verified ' || verified_on else '' end
                 when 'needs_review' then 'review: something changed since the last seal'
                 when 'unsealed' then case when preexisting
                   then 'no generation · sealed on request only'
                   else 'no generation · due after 168 h without changes' end
                 when 'changed' then
                   'added files · appended after 168 h without changes'
                 when 'queued' then 'queued · outside working hours'
                 when 'hashing' then 'reading files'
                 when 'ignored' then 'ignored'
                 else 'missing: not on disk since '
                   || strftime({at_home('missing_since')}, '%Y-%m-%d %H:%M') end as status,
               concat_ws(' · ',
                 case when state = 'missing' and sealed_on <> '' then 'sealed ' || sealed_on end,
                 file_count || case when file_count = 1 then ' file' else ' files' end,
                 case when state = 'missing' and verified_on <> '' then 'verified OK ' || verified_on end)
                 as meta,
               case state
                 when 'sealed' then concat_ws('; ', 'generation of ' || sealed_on,
                   case when verified_on <> '' then 'proved on ' || verified_on end)
                 when 'needs_review' then 'held for review: changed'
                 when 'unsealed' then case when preexisting then 'first generation on request'
                   else 'first generation after 168 quiet hours' end
                 when 'changed' then 'partial generation after 168 quiet hours'
                 when 'queued' then 'work item waits for its hours'
                 when 'hashing' then 'files are being read'
                 when 'ignored' then 'not scanned'
                 else 'absent since ' || strftime({at_home('missing_since')}, '%Y-%m-%d %H:%M') end as detail
        from (select *, coalesce(strftime({at_home('last_sealed_at')}, '%Y-%m-%d'), '') as sealed_on,
                     coalesce(strftime({at_home('last_verified_at')}, '%Y-%m-%d'), '') as verified_on
              from fx_known)""",
)
def status_fields(fx: Fixtures) -> DataFrame:
    return reports.status_fields(fx["fx_known"], ZONE, 168, now())


WORK_NAMES = """
named as (
  select j.*, p.name, case when j.id % 4 = 0 then 'reason ' || j.id end as review
  from fx_jobs j left join fx_projects p on p.id = j.project_id),
labelled as (
  select *,
    case kind when 'accept_new_version' then 'new version' when 'root_manifest' then 'archive manifest'
      else kind end as work,
    kind = 'verify' and trigger_kind = 'manual' as by_hand,
    case when by_hand then 'Verify now' else work || ' running:' end as running_label,
    case when by_hand then 'Verify now' else work || ' queued:' end as queued_label,
    work || ' done:' as done_label, work || ' failed:' as failed_label
  from named)"""


def _reviews(fx: Fixtures) -> DataFrame:
    jobs_rows = fx["fx_jobs"]
    review = F.concat(F.lit("needs review, nothing written: reason "), F.col("id").cast("string"))
    log = jobs_rows.select(
        F.col("id").alias("job_id"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("seq"), F.lit("start").alias("msg")),
                F.struct(
                    F.lit(2).alias("seq"),
                    F.when(F.col("id") % 4 == 0, review).otherwise("wrote it").alias("msg"),
                ),
            )
        ).alias("line"),
    ).select("job_id", "line.*")
    return reports.review_of_work(log)


@query(
    ("fx_jobs",),
    "select id, 'reason ' || id as review from fx_jobs where id % 4 = 0",
)
def review_of_work(fx: Fixtures) -> DataFrame:
    return _reviews(fx)


@query(
    PLANNED,
    f"""select section, cast(rank as int) as rank, "when", id, tone, text, detail, percent from (
         select 0 as section, row_number() over (order by id desc) as rank, 'now' as "when", id, 'running' as tone, concat_ws(' ', running_label, name) as text,
                files_done || ' of ' || files_total || ' files · 0 B of 0 B' as detail,
                least(100, cast(floor(files_done * 100 / files_total) as bigint)) as percent
         from labelled where state = 'running'
         union all
         select 1, row_number() over (order by priority desc, id) as rank, 'next', id, 'queued',
                concat_ws(' ', queued_label, name), '', null
         from labelled where state = 'queued' qualify rank <= 8
         union all
         select 1, 9, 'next', null, 'queued', 'and ' || (count(*) - 8) || ' more', '', null
         from labelled where state = 'queued' having count(*) > 8
         union all
         select 2, row_number() over (order by finished_at desc, id desc) as rank,
                strftime({at_home('finished_at')}, '%Y-%m-%d %H:%M'), id,
                case when state = 'done' and review is not null then 'review' else state end,
                case when state = 'failed' then concat_ws(' ', failed_label, name)
                     when state = 'cancelled' then 'cancelled, ' || concat_ws(' ', queued_label, name)
                     when review is not null and kind = 'verify'
                       then concat_ws(' ', 'verify found problems:', name)
                     when review is not null then concat_ws(' ', 'held for review:', name)
                     else concat_ws(' ', done_label, name) end,
                case when state = 'done' and review is not null and kind = 'verify' then review
                     when state = 'done' and review is not null then 'nothing recorded: ' || review
                     when state = 'done' then files_total || ' files · 0 B' else '' end, null
         from labelled where state not in ('running', 'queued') qualify rank <= 8
         union all
         select 2, 9, 'before', null, 'older', 'and ' || (count(*) - 8) || ' more', '', null
         from labelled where state not in ('running', 'queued') having count(*) > 8)""",
    ctes=WORK_NAMES,
)
def activity_log(fx: Fixtures) -> DataFrame:
    work = fx["fx_jobs"].withColumns(
        {"bytes_done": F.lit(0).cast("bigint"), "bytes_total": F.lit(0).cast("bigint")}
    )
    names = fx["fx_projects"].select(F.col("id").alias("project_id"), "name")
    return reports.activity_log(work, now(), ZONE, _reviews(fx), names)


# --- time ------------------------------------------------------------------------------------


@query(
    (),
    f"""select event_id,
               (isodow(wall) between 1 and 5 and cast(wall as time) >= time '22:00:00')
               or (isodow(wall - interval 1 day) between 1 and 5 and cast(wall as time) < time '06:00:00')
                 as night,
               isodow(wall) between 1 and 5 and cast(wall as time) >= time '09:00:00'
                 and cast(wall as time) < time '20:00:00' as office
        from (select event_id, {at_home('ts')} as wall from events)""",
)
def is_working(fx: Fixtures) -> DataFrame:
    ts = F.col("ts")
    return fx.table("events").select(
        "event_id",
        times.is_working(ts, NIGHT).alias("night"),
        times.is_working(ts, OFFICE).alias("office"),
    )


@query(
    (),
    f"""select e.event_id, min(timezone('UTC', timezone('{ZONE}', c.wall))) as next_change
        from (select event_id, ts, {at_home('ts')} as wall,
                     isodow({at_home('ts')}) between 1 and 5
                     and cast({at_home('ts')} as time) >= time '09:00:00'
                     and cast({at_home('ts')} as time) < time '20:00:00' as working from events) e,
             (select unnest(generate_series(timestamp '2023-12-30', timestamp '2024-02-10', interval 1 day))
                as day) d,
             lateral (select unnest([d.day + interval 9 hour, d.day + interval 20 hour]) as wall,
                             unnest([true, false]) as opens) c
        where c.wall > e.wall and isodow(c.wall) between 1 and 5 and c.opens <> e.working
          and c.wall <= e.wall + interval 8 day
        group by 1""",
)
def next_change(fx: Fixtures) -> DataFrame:
    return fx.table("events").select(
        "event_id", times.next_change(F.col("ts"), OFFICE).alias("next_change")
    )


@query(
    (),
    """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso, ts as parsed from events""",
)
def iso_time(fx: Fixtures) -> DataFrame:
    iso = times.iso_text(F.col("ts"))
    return fx.table("events").select("event_id", iso.alias("iso"), times.parse_iso(iso).alias("parsed"))
