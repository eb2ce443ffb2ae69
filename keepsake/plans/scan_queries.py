"""Discovery, snapshot diff, and lost or moved projects over the archive views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import ArchiveConfig
from keepsake.operators import diff, discovery, lifecycle
from keepsake.plans.fixtures import NOW, Fixtures
from keepsake.plans.registry import query
from keepsake.plans.scan import PROJECT_COLUMNS
from keepsake.plans.scan import scan_archive as run_scan


def now() -> Column:
    return F.expr(NOW)


NOW_NS = 896_702_400_000_000_000  # of NOW
SETTLE_NOW_NS = 1_700_700_000_000_000_000  # shortly after the newest files of fx_current

USABLE = "not regexp_matches({0}, '(^|/)([_@#.]|ascmhl(/|$)|ascmhl_superseded(/|$))')"
INSIDE = f"""
inside as (
  select *, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as project,
         array_to_string(string_split(path, '/')[3:], '/') as rel_path
  from fx_archive
  where len(string_split(path, '/')) > 2
    and {USABLE.format("split_part(path, '/', 1) || '/' || split_part(path, '/', 2)")})"""
IGNORED = (
    "(starts_with(rel_path, 'ascmhl/')"
    " or regexp_matches(rel_path, '(^|/)([.]DS_Store|[.]_[^/]*|Thumbs[.]db|@eaDir|#recycle)(/|$)')"
    " or regexp_matches(rel_path, '(^|/)(ascmhl|ascmhl_superseded)/'))"
)
GLOBS = ("*7.mov", "1?.mov", "[2-4]*.png")
GLOBBED = "(name glob '*7.mov' or name glob '1?.mov' or name glob '[2-4]*.png')"


@query(
    ("fx_archive",),
    """select project as rel_path, split_part(project, '/', 2) as name,
              bool_or(starts_with(rel_path, 'ascmhl/')) as has_history
       from inside group by project""",
    ctes=INSIDE,
)
def discover_projects(fx: Fixtures) -> DataFrame:
    return discovery.discover_projects(fx["fx_archive"])


@query(
    ("fx_archive",),
    """select project, bool_or(starts_with(rel_path, 'ascmhl/')) as owns_folder,
              bool_or(rel_path = 'ascmhl/ascmhl_chain.xml') as owns_chain
       from inside group by project""",
    ctes=INSIDE,
)
def has_history(fx: Fixtures) -> DataFrame:
    return discovery.has_history(fx["fx_archive"])


@query(
    ("fx_archive",),
    f"""select path, kind from fx_archive
        where len(string_split(path, '/')) <= 2 and {USABLE.format('path')}""",
)
def stray_entries(fx: Fixtures) -> DataFrame:
    return discovery.stray_entries(fx["fx_archive"]).select("path", "kind")


def _files(fx: Fixtures) -> DataFrame:
    inside = discovery.with_project(fx["fx_archive"])
    return discovery.regular_files(inside).select("project", "rel_path", "size")


@query(
    ("fx_archive",),
    f"select project, rel_path, size from inside where kind = 'file' and not {IGNORED}",
    ctes=INSIDE,
)
def apply_ignore_patterns(fx: Fixtures) -> DataFrame:
    return discovery.apply_ignore_patterns(_files(fx))


@query(
    ("fx_archive",),
    f"""select project, rel_path, size
        from (select *, split_part(rel_path, '/', -1) as name from inside)
        where kind = 'file' and not {GLOBBED}""",
    ctes=INSIDE,
)
def apply_exclude_globs(fx: Fixtures) -> DataFrame:
    return discovery.apply_exclude_globs(_files(fx), GLOBS)


LATEST = """
latest as (
  select project, '*' || regexp_extract(rel_path, '([.][^.]+)$', 1) as pattern
  from fx_sealed where contains(rel_path, '.') group by 1, 2),
fixed as (
  select unnest(['.DS_Store', '._*', 'Thumbs.db', '@eaDir', '#recycle'.replace('#', chr(92) || '#'),
                 'ascmhl/', 'ascmhl_superseded/', '*.wav', '*.md']) as pattern,
         unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) as n)"""


def _latest_patterns(fx: Fixtures) -> DataFrame:
    """A history per project whose patterns are its own suffixes, in order."""
    kinds = fx["fx_sealed"].where(F.col("rel_path").contains(".")).select(
        "project",
        F.concat(F.lit("*"), F.regexp_extract("rel_path", "([.][^.]+)$", 1)).alias("pattern"),
    )
    return (
        kinds.distinct()
        .groupBy("project")
        .agg(F.array_sort(F.collect_list("pattern")).alias("latest_patterns"))
    )


@query(
    ("fx_sealed",),
    """select project, pattern, row_number() over (partition by project order by origin, n, pattern) - 1
              as position
       from (select project, pattern, min(origin) as origin, min(n) as n
             from (select project, pattern, 0 as origin, 0 as n from latest
                   union all
                   select project, fixed.pattern, 1, n from (select distinct project from latest), fixed)
             group by project, pattern)""",
    ctes=LATEST,
)
def effective_patterns(fx: Fixtures) -> DataFrame:
    out = discovery.effective_patterns(_latest_patterns(fx), globs=("*.wav", "*.md"))
    rows = out.select("project", F.posexplode("patterns").alias("position", "pattern"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query(
    ("fx_projects",),
    """select count(last_generation_no) > 0 as any_sealed,
              case when count(last_generation_no) > 0 then '*.md, *.tmp' else '' end as kept_globs
       from fx_projects""",
)
def removed_globs(fx: Fixtures) -> DataFrame:
    return discovery.removed_globs(("*.md", "*.wav", "*.tmp"), ("*.wav",), fx["fx_projects"])


@query(
    ("fx_sealed",),
    """select pattern, row_number() over (order by origin, project, n, pattern) as position
       from (select pattern, min(origin) as origin, min(project) as project,
                    coalesce(min(n) filter (origin = 0), 0) as n from (
               select pattern, 1 as origin, project, 0 as n from latest
               union all select pattern, 0, '', n from fixed where pattern <> '*.md'
               union all select '_*', 0, '', 10 union all select '@*', 0, '', 11
               union all select chr(92) || '#*', 0, '', 12 union all select '.*', 0, '', 13)
             group by pattern)""",
    ctes=LATEST,
)
def root_patterns(fx: Fixtures) -> DataFrame:
    referenced = _latest_patterns(fx).select(
        F.col("project").alias("rel_path"), F.col("latest_patterns").alias("patterns")
    )
    return discovery.root_patterns(referenced, globs=("*.wav",))


@query(
    ("fx_archive",),
    f"""select project, count(*) filter (kind = 'file' and not {IGNORED}
                and not regexp_matches(rel_path, '[02468][.]mov$')) as files,
               cast(0 as bigint) as errors,
               count(*) filter (kind = 'file' and not {IGNORED}
                and not regexp_matches(rel_path, '[02468][.]mov$')) = 0 as is_empty
        from inside group by project""",
    ctes=INSIDE,
)
def empty_projects(fx: Fixtures) -> DataFrame:
    return discovery.project_contents(fx["fx_archive"], globs=("*[02468].mov",))


@query(
    ("fx_archive",),
    f"""select distinct split_part(path, '/', 1) as project,
               regexp_extract(path, '^[^/]+/(.+)/ascmhl/[^/]+$', 1) as nested
        from fx_archive
        where {USABLE.format("split_part(path, '/', 1)")}
          and regexp_matches(path, '^[^/]+/.+/ascmhl/[^/]+$')""",
)
def nested_histories(fx: Fixtures) -> DataFrame:
    return discovery.nested_histories(fx["fx_archive"], depth=0)


DIFF = """
diff as (
  select coalesce(c.project, s.project) as project, coalesce(c.rel_path, s.rel_path) as rel_path,
         case when s.rel_path is null then 'added' when c.rel_path is null then 'deleted'
              when c.size <> s.size or abs(c.mtime_ns - s.mtime_ns) > 1000000000 then 'modified'
              else 'unchanged' end as change,
         s.size as old_size, s.mtime_ns as old_mtime_ns,
         c.size as new_size, c.mtime_ns as new_mtime_ns
  from fx_current c full join fx_sealed s on c.project = s.project and c.rel_path = s.rel_path),
counts as (
  select project, count(*) filter (change = 'added') as added,
         count(*) filter (change = 'modified') as modified,
         count(*) filter (change = 'deleted') as deleted,
         count(*) filter (change = 'unchanged') as unchanged,
         count(new_size) as files, cast(coalesce(sum(new_size), 0) as bigint) as total_bytes,
         coalesce(max(new_mtime_ns), 0) as newest_mtime_ns
  from diff group by project),
steady as (
  select coalesce(c.project, p.project) as project,
         count(p.rel_path) > 0
         and count(*) filter (c.size is null or p.size is null or c.size <> p.size
                              or c.mtime_ns <> p.mtime_ns) = 0 as stable
  from fx_current c full join fx_previous p on c.project = p.project and c.rel_path = p.rel_path
  group by 1)"""
BOTH = ("fx_current", "fx_sealed")
THREE = ("fx_current", "fx_previous", "fx_sealed")


def _diff(fx: Fixtures) -> DataFrame:
    return diff.diff_against_sealed(fx["fx_current"], fx["fx_sealed"])


def _summary(fx: Fixtures) -> DataFrame:
    return diff.diff_summary(fx["fx_current"], fx["fx_sealed"], fx["fx_previous"])


@query(THREE, "select * from diff", ctes=DIFF)
def diff_against_sealed(fx: Fixtures) -> DataFrame:
    return _diff(fx)


@query(THREE, "select c.*, s.stable from counts c join steady s on s.project = c.project", ctes=DIFF)
def diff_summary(fx: Fixtures) -> DataFrame:
    return _summary(fx)


@query(THREE, "select project, stable from steady", ctes=DIFF)
def stability(fx: Fixtures) -> DataFrame:
    return diff.stability(fx["fx_current"], fx["fx_previous"])


@query(
    THREE,
    f"""select c.project, s.stable, c.newest_mtime_ns,
               s.stable and {SETTLE_NOW_NS} - c.newest_mtime_ns >= 604800000000000 as settled
        from counts c join steady s on s.project = c.project""",
    ctes=DIFF,
)
def settled(fx: Fixtures) -> DataFrame:
    out = diff.settled(_summary(fx), SETTLE_NOW_NS, 168)
    return out.select("project", "stable", "newest_mtime_ns", "settled")


@query(
    BOTH,
    """select project, rel_path, size, mtime_ns from fx_current c
       where not exists (select 1 from fx_sealed s where s.project = c.project
                         and s.rel_path = c.rel_path and s.size = c.size
                         and s.mtime_ns = c.mtime_ns)""",
)
def unsealed_files(fx: Fixtures) -> DataFrame:
    out = diff.unsealed_files(fx["fx_current"], fx["fx_sealed"])
    return out.select("project", "rel_path", "size", "mtime_ns")


REASONS = """
bad as (select *, row_number() over (partition by project order by rel_path) as n
        from diff where change in ('modified', 'deleted')),
reasons as (
  select project,
         concat_ws(' and ',
           case when count(*) filter (change = 'modified') > 0
                then count(*) filter (change = 'modified') || ' modified' end,
           case when count(*) filter (change = 'deleted') > 0
                then count(*) filter (change = 'deleted') || ' deleted' end)
         || ' since the last seal: ' || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end
         as review_reason
  from bad group by project),
projects as (
  select project, case cast(substr(project, 4) as int) % 6 when 0 then 'queued'
           when 1 then 'needs_review' when 2 then 'ignored' else 'sealed' end as state,
         case cast(substr(project, 4) as int) % 6 when 1 then 'kept reason' end as review_reason,
         case when project in ('src19', 'src9') then null else 1 end as last_generation_no,
         cast(substr(project, 4) as int) % 2 = 0 as preexisting
  from (select distinct project from fx_current))"""


def _projects(fx: Fixtures) -> DataFrame:
    number = F.expr("substring(project, 4)").cast("int")
    kind = number % 6
    return (
        fx["fx_current"]
        .select("project")
        .distinct()
        .select(
            "project",
            F.when(kind == 0, "queued")
            .when(kind == 1, "needs_review")
            .when(kind == 2, "ignored")
            .otherwise("sealed")
            .alias("state"),
            F.when(kind == 1, "kept reason").alias("review_reason"),
            F.when(~F.col("project").isin("src19", "src9"), 1).alias("last_generation_no"),
            (number % 2 == 0).alias("preexisting"),
        )
    )


CLASSIFIED = """
classified as (
  select p.project, p.state, p.preexisting,
         case when p.state in ('ignored', 'queued', 'hashing', 'needs_review') then p.state
              when p.last_generation_no is null then 'unsealed'
              when c.modified + c.deleted > 0 then 'needs_review'
              when c.added > 0 then 'changed' else 'sealed' end as new_state
  from projects p left join counts c on c.project = p.project)"""


@query(
    THREE,
    """select c.project, c.state, c.new_state,
              case when c.state in ('ignored', 'queued', 'hashing', 'needs_review')
                   then p.review_reason
                   when c.new_state = 'needs_review' then r.review_reason end as new_reason
       from classified c join projects p on p.project = c.project
       left join reasons r on r.project = c.project""",
    ctes=DIFF + "," + REASONS + "," + CLASSIFIED,
)
def classify(fx: Fixtures) -> DataFrame:
    rows = _diff(fx)
    out = diff.classify(_projects(fx), _summary(fx), diff.review_reason(rows))
    return out.select("project", "state", "new_state", "new_reason")


@query(THREE, "select project, review_reason from reasons", ctes=DIFF + "," + REASONS)
def review_reason(fx: Fixtures) -> DataFrame:
    return diff.review_reason(_diff(fx))


@query(
    THREE,
    """select project, rel_path, change, old_size, new_size, old_mtime_ns, new_mtime_ns
       from diff where change in ('modified', 'deleted')
       union all
       select project, rel_path, 'modified', null, size, null, mtime_ns from fx_previous
       where project = 'src19' and size % 5 = 0""",
    ctes=DIFF,
)
def review_items(fx: Fixtures) -> DataFrame:
    """The stored list of the never-sealed project stays; every other one is renewed."""
    rows = _diff(fx)
    stored = fx["fx_previous"].where("size % 5 = 0").select(
        "project",
        "rel_path",
        F.lit("modified").alias("change"),
        F.lit(None).cast("bigint").alias("old_size"),
        F.col("size").alias("new_size"),
        F.lit(None).cast("bigint").alias("old_mtime_ns"),
        F.col("mtime_ns").alias("new_mtime_ns"),
    )
    return diff.review_items(rows, stored)


@query(
    THREE,
    f"""select c.project, c.new_state as state,
               case when c.new_state = 'unsealed' and not c.preexisting and settled then 'seal'
                    when c.new_state = 'changed' and settled then 'append' end as work
        from (select c.*, s.stable and {SETTLE_NOW_NS} - n.newest_mtime_ns >= 0 as settled
              from classified c join steady s on s.project = c.project
              join counts n on n.project = c.project) c""",
    ctes=DIFF + "," + REASONS + "," + CLASSIFIED,
)
def auto_work(fx: Fixtures) -> DataFrame:
    summary = _summary(fx)
    states = diff.classify(_projects(fx), summary).select(
        "project", F.col("new_state").alias("state"), "preexisting"
    )
    quiet = diff.settled(summary, SETTLE_NOW_NS, 0).select("project", "settled")
    return diff.auto_work(states.join(quiet, "project")).select("project", "state", "work")


@query(
    ("fx_archive",),
    """select project, count(*) as errors, 'error' as state,
              'scan errors: ' || string_agg(entry, ', ' order by entry) filter (n <= 10)
              || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end as error
       from (select project, rel_path || ': Permission denied' as entry,
                    row_number() over (partition by project order by rel_path || ': Permission denied') as n
             from inside where kind = 'symlink')
       group by project""",
    ctes=INSIDE,
)
def scan_health(fx: Fixtures) -> DataFrame:
    """The symlinks of the listing stand for entries that could not be read."""
    entries = discovery.with_project(fx["fx_archive"]).withColumn(
        "error", F.when(F.col("kind") == "symlink", "Permission denied")
    )
    return diff.scan_health(entries)


@query(
    ("fx_known",),
    f"""select id, case when scanned then {NOW} else last_scan_at end as last_scan_at,
               case when scanned then id * 3 else file_count end as file_count,
               case when scanned then id * 1000 else total_bytes end as total_bytes,
               case when scanned and not stable then {NOW} else last_change_at end as last_change_at,
               case when scanned and (not stable or stable_since is null) then {NOW}
                    else stable_since end as stable_since
        from (select *, id % 7 <> 0 as scanned, id % 2 = 0 as stable from fx_known)""",
)
def update_scan_fields(fx: Fixtures) -> DataFrame:
    known = fx["fx_known"]
    summary = known.where("id % 7 <> 0").select(
        "id",
        (F.col("id") * 3).alias("files"),
        (F.col("id") * 1000).alias("total_bytes"),
        (F.col("id") % 2 == 0).alias("stable"),
    )
    out = diff.update_scan_fields(known, summary, now(), by=("id",))
    return out.select(
        "id", "last_scan_at", "file_count", "total_bytes", "last_change_at", "stable_since"
    )


@query(
    ("fx_known", "fx_listing"),
    f"""select coalesce(l.rel_path, k.rel_path) as rel_path, coalesce(l.name, k.name) as name,
               case when k.rel_path is null then false else k.preexisting end as preexisting,
               case when k.rel_path is null then {NOW} else k.first_seen end as first_seen
        from fx_listing l full join fx_known k on k.rel_path = l.rel_path""",
)
def preexisting(fx: Fixtures) -> DataFrame:
    return diff.mark_preexisting(fx["fx_listing"], fx["fx_known"], False, now())


@query(
    ("fx_known", "fx_listing"),
    """select d.n as discovered, k.n as known, d.n = 0 and k.n > 0 as unreachable
       from (select count(*) as n from fx_listing) d,
            (select count(*) as n from fx_known where state <> 'ignored') k""",
)
def unreachable_guard(fx: Fixtures) -> DataFrame:
    return lifecycle.unreachable_guard(fx["fx_listing"], fx["fx_known"])


GONE = """
gone as (
  select k.*, k.state = 'missing' or split_part(k.rel_path, '/', 1) not in
              (select path from fx_listing_errors) as confirmed
  from fx_known k
  where k.state <> 'ignored' and k.rel_path not in (select rel_path from fx_listing))"""
LIFE = ("fx_known", "fx_listing", "fx_listing_errors")
RESTING = "case when last_generation_no is not null then 'sealed' else 'unsealed' end"


@query(
    LIFE,
    f"""select id, 'missing' as state,
               case when state <> 'missing' then {NOW} else missing_since end as missing_since,
               case when state = 'missing' then state_before_missing
                    when state in ('queued', 'hashing', 'error') then {RESTING}
                    else state end as state_before_missing,
               state <> 'missing' as newly_missing
        from gone where confirmed""",
    ctes=GONE,
)
def mark_missing(fx: Fixtures) -> DataFrame:
    out = lifecycle.mark_missing(
        fx["fx_known"], fx["fx_listing"], now(), fx["fx_listing_errors"]
    )
    return out.select("id", "state", "missing_since", "state_before_missing", "newly_missing")


@query(
    ("fx_known", "fx_listing", "fx_jobs"),
    f"""select j.id, case when j.state = 'queued' and g.id is not null then 'cancelled'
                          else j.state end as state,
               case when j.state = 'queued' and g.id is not null then {NOW}
                    else j.finished_at end as finished_at
        from fx_jobs j left join (
          select id from fx_known where state not in ('ignored', 'missing')
            and rel_path not in (select rel_path from fx_listing)) g on g.id = j.project_id""",
)
def cancel_open_work(fx: Fixtures) -> DataFrame:
    gone = lifecycle.mark_missing(fx["fx_known"], fx["fx_listing"], now()).where("newly_missing")
    out = lifecycle.cancel_open_work(fx["fx_jobs"], gone, now())
    return out.select("id", "state", "finished_at")


@query(
    LIFE,
    f"""select id, state, last_generation_no is not null and state in ('sealed', 'changed') as verify
        from (select id, last_generation_no,
                     case when state_before_missing is null
                            or state_before_missing in ('queued', 'hashing', 'error', 'missing')
                          then {RESTING} else state_before_missing end as state
              from fx_known where state = 'missing'
                and rel_path in (select rel_path from fx_listing))""",
)
def restore(fx: Fixtures) -> DataFrame:
    out = lifecycle.restore(fx["fx_known"], fx["fx_listing"])
    return out.select("id", "state", "verify")


PAIRS = """
files as (
  select project_id, generation_no, digest as fingerprint, is_full,
         cast(project_id as varchar) || '/' || cast(generation_no as varchar) || '/' || rel_path as path,
         case when generation_no % 4 <> 0
              then timestamp '1998-01-01 00:00:00' + to_days(cast(generation_no as int)) end as missing_since
  from fx_gen_files),
fresh as (select fingerprint, path, row_number() over (partition by fingerprint order by path) as n
          from files where not is_full),
gone as (select fingerprint, path, project_id, row_number() over (
           partition by fingerprint
           order by missing_since is not null, missing_since desc, path) as n
         from files where is_full)"""


@query(
    ("fx_gen_files",),
    """select g.project_id as id, g.path as old_path, f.path as new_path
       from fresh f join gone g on g.fingerprint = f.fingerprint and g.n = f.n""",
    ctes=PAIRS,
)
def match_moved(fx: Fixtures) -> DataFrame:
    """Three fingerprints only: each holds a third of all rows."""
    files = fx.staged("fx_gen_files").select(
        F.col("project_id").alias("id"),
        F.col("digest").alias("fingerprint"),
        "is_full",
        F.concat_ws("/", "project_id", "generation_no", "rel_path").alias("rel_path"),
        F.when(
            F.col("generation_no") % 4 != 0,
            F.expr("timestamp '1998-01-01 00:00:00'") + F.make_dt_interval(F.col("generation_no")),
        ).alias("missing_since"),
    )
    return lifecycle.match_moved(files.where(~F.col("is_full")), files.where("is_full"))


@query(
    ("fx_projects",),
    """select id, case when id % 10 = 4 then '2031/' || name || ' moved' else rel_path end as rel_path,
              case when id % 10 = 4 then name || ' moved' else name end as name
       from fx_projects""",
)
def rename_project(fx: Fixtures) -> DataFrame:
    projects = fx["fx_projects"]
    moved = projects.where("id % 10 = 4").select(
        "id",
        F.col("rel_path").alias("old_path"),
        F.concat(F.lit("2031/"), "name", F.lit(" moved")).alias("new_path"),
    )
    return lifecycle.rename_project(projects, moved).select("id", "rel_path", "name")


REFUSED = """
asked as (
  select p.id, p.rel_path,
         case when p.state <> 'missing' then 'only a missing project can be retired'
              when p.id in (select project_id from fx_jobs where state = 'running')
              then 'a job is still stopping' end as refused
  from fx_projects p where p.id % 9 in (7, 8))"""


def _asked(fx: Fixtures) -> DataFrame:
    projects = fx["fx_projects"]
    return lifecycle.forgettable(projects, projects.where("id % 9 in (7, 8)"), fx["fx_jobs"])


@query(
    ("fx_projects", "fx_jobs"),
    """select 'job' as what, id, kind as text from fx_jobs
       where project_id not in (select id from asked where refused is null)
       union all
       select 'refused', id, refused from asked where refused is not null
       union all
       select 'trace', id, 'retired ' || rel_path || ' (history mirror deleted)' from asked
       where refused is null""",
    ctes=REFUSED,
)
def forget_project(fx: Fixtures) -> DataFrame:
    """What is left of the work log, who was refused, and the trace of the forgotten."""
    asked = _asked(fx)
    gone = asked.where(F.col("refused").isNull())
    left = lifecycle.forget(fx["fx_jobs"], gone)
    trace = lifecycle.forget_trace(gone.select("id", "rel_path"), now())
    ids = F.regexp_extract("msg", "Customer#0*([0-9]+)", 1).cast("bigint")
    return (
        left.select(F.lit("job").alias("what"), "id", F.col("kind").alias("text"))
        .unionByName(
            asked.where(F.col("refused").isNotNull()).select(
                F.lit("refused").alias("what"), "id", F.col("refused").alias("text")
            )
        )
        .unionByName(
            trace.select(F.lit("trace").alias("what"), ids.alias("id"), F.col("msg").alias("text"))
        )
    )


@query(
    LIFE,
    """select (select count(*) from fx_listing) as discovered,
              (select count(*) from fx_listing
               where rel_path not in (select rel_path from fx_known)) as new,
              (select count(*) from gone where confirmed) as missing,
              (select count(*) from fx_known where state = 'missing'
                 and rel_path in (select rel_path from fx_listing)) as reappeared,
              cast(0 as bigint) as moved,
              (select count(*) from fx_listing
               where rel_path not in (select rel_path from fx_known where state = 'ignored')) as scanned,
              cast(0 as bigint) as enqueued,
              (select count(*) from gone where not confirmed) as errors""",
    ctes=GONE,
)
def scan_summary(fx: Fixtures) -> DataFrame:
    return lifecycle.scan_summary(fx["fx_listing"], fx["fx_known"], fx["fx_listing_errors"])


TRACKED = """
numbers as (select distinct cast(substr(source, 4) as int) as n from documents),
tracked as (
  select n as id, concat('2024/src', cast(n as string)) as rel_path, 'sealed' as state,
         1 as last_generation_no, n from numbers
  union all
  select 100 + n, concat('2025/src', cast(n as string)),
         case when n % 4 = 0 then 'missing' else 'unsealed' end,
         case when n % 4 = 0 then 1 end, n from numbers where n % 2 = 0
  union all
  select 200 + n, concat('2023/src', cast(n as string)), 'sealed', 1, n from numbers
  where n % 5 = 0)"""


@query(
    ("fx_archive",),
    """select coalesce(m.new_path, t.rel_path) as rel_path, file_count,
              case when t.id >= 200 and m.new_path is null then 'missing'
                   when t.id >= 200 then 'changed'
                   when coalesce(f.file_count, 0) = 0 then 'missing'
                   when t.id >= 100 then 'queued'
                   when f.n_modified > 0 then 'needs_review' when f.n_added > 0 then 'queued'
                   else 'sealed' end as state,
              case when t.id >= 200 or coalesce(f.file_count, 0) = 0 then ''
                   when t.id >= 100 then case when t.state = 'missing' then 'append,verify' else 'seal' end
                   when f.n_modified = 0 and f.n_added > 0 then 'append' else '' end as work
       from tracked t
       left join moves m on m.id = t.id
       left join files f on f.project = coalesce(m.new_path, t.rel_path)
       union all
       select f.project, f.file_count, 'unsealed', '' from files f
       where f.project not in (select rel_path from tracked)
         and f.project not in (select new_path from moves)""",
    ctes=INSIDE
    + ","
    + TRACKED
    + f""",
files as (
  select project, count(*) as file_count,
         count(*) filter (project = '2024/src3' and number % 11 = 0 and number % 7 <> 0) as n_modified,
         count(*) filter (cast(regexp_extract(project, '([0-9]+)$', 1) as int) < 10
                          and number % 7 = 0) as n_added
  from (select *, cast(regexp_extract(rel_path, '([0-9]+)[.]mov$', 1) as int) as number
        from inside where kind = 'file' and not {IGNORED})
  group by project),
moves as (
  select t.id, f.project as new_path from tracked t
  join files f on f.project = '2025/src' || (t.n + 1)
  where t.id >= 200 and t.n % 2 = 0)""",
)
def scan_archive(fx: Fixtures) -> DataFrame:
    """A whole scan: known, lost, returned, renamed and new projects in one listing."""
    mtime = F.lit(10**18).alias("mtime_ns")
    none = F.lit(None).cast("string")
    listing = fx["fx_archive"].select("path", "kind", "size", mtime, none.alias("error"))
    fx.table("documents").createOrReplaceTempView("documents")
    tracked = fx.spark.sql(f"with {TRACKED} select * from tracked")
    returned = F.when(F.col("state") == "missing", "changed")
    known = tracked.select(
        F.col("id").cast("bigint").alias("id"),
        "rel_path",
        F.element_at(F.split("rel_path", "/"), -1).alias("name"),
        "state",
        none.alias("review_reason"),
        none.alias("error"),
        F.lit(False).alias("preexisting"),
        "last_generation_no",
        F.expr("timestamp '1998-01-01 00:00:00'").alias("first_seen"),
        *[
            F.lit(None).cast("timestamp").alias(c)
            for c in ("last_scan_at", "last_change_at", "stable_since")
        ],
        F.lit(None).cast("bigint").alias("file_count"),
        F.lit(None).cast("bigint").alias("total_bytes"),
        F.when(F.col("state") == "missing", now()).alias("missing_since"),
        returned.alias("state_before_missing"),
    ).select(*PROJECT_COLUMNS)
    files = discovery.apply_ignore_patterns(
        discovery.regular_files(discovery.with_project(listing))
    )
    number = F.regexp_extract("rel_path", "([0-9]+)[.]mov$", 1).try_cast("int")
    ids = known.where("id < 200").select("id", F.col("rel_path").alias("project"))
    previous = files.join(ids, "project").select("id", "rel_path", "size", "mtime_ns")
    grown = (F.col("id") == 3) & (number % 11 == 0)
    sealed = previous.where((F.col("id") < 100) & ((F.col("id") >= 10) | (number % 7 != 0)))
    sealed = sealed.withColumn("size", F.col("size") + F.when(grown, 1).otherwise(0))
    items = previous.limit(0).select(
        "id", "rel_path", none.alias("change"),
        *[F.col("size").alias(c) for c in ("old_size", "new_size", "old_mtime_ns", "new_mtime_ns")],
    )
    lost = tracked.where("id >= 200 and n % 2 = 0")
    mark = F.md5(F.concat(F.lit("chain"), F.col("n").cast("string"))).alias("fingerprint")
    kept = lost.select(F.col("id").cast("bigint").alias("id"), mark)
    next_one = F.concat(F.lit("2025/src"), (F.col("n") + 1).cast("string")).alias("rel_path")
    chains = lost.select(next_one, mark)
    out = run_scan(
        listing, known, sealed, previous, items, chains, kept, now(), 2 * 10**18,
        ArchiveConfig(settle_hours=1),
    )
    work = out.work.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("work")
    )
    return out.projects.join(work, "id", "left").select(
        "rel_path", "state", "file_count", F.coalesce("work", F.lit("")).alias("work")
    )
