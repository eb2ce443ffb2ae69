"""Digests, origin reconciliation and generations over the archive views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators import diff, digests, generations, origin, rollup
from keepsake.plans import jobs
from keepsake.plans.fixtures import NOW, Fixtures
from keepsake.plans.registry import query
from keepsake.plans.scan_queries import BOTH, DIFF, THREE, now

FILES = ("fx_current", "fx_sealed", "fx_legacy")


def _md5_rows(df: DataFrame) -> DataFrame:
    return df.select("project", "rel_path", F.lit("md5").alias("fmt"), "digest")


def _stored(fx: Fixtures) -> DataFrame:
    """Digests kept from the last read: the sealed ones."""
    return fx["fx_sealed"].where(F.col("digest").isNotNull()).select(
        "project", "rel_path", "size", "mtime_ns", F.lit("md5").alias("fmt"), "digest"
    )


NORMAL = """
normal as (
  select project, manifest, rel_path, doc_id * 2 as position,
         case tag when 'md5' then 'md5' when 'xxhash64' then 'xxh64' end as fmt,
         case tag when 'md5' then lower(value)
              when 'xxhash64' then substr(value, 15, 2) || substr(value, 13, 2) || substr(value, 11, 2)
                || substr(value, 9, 2) || substr(value, 7, 2) || substr(value, 5, 2)
                || substr(value, 3, 2) || substr(value, 1, 2) end as digest,
         case when tag = 'xxhash' then split_part(manifest, '/', -1) || ': ' || rel_path
                || ': XXH32 (xxhash) has no equivalent, skipped' end as warning
  from fx_legacy),
ranked as (
  select *, row_number() over (partition by project, rel_path, fmt
                               order by split_part(manifest, '/', 1), manifest, position) as n,
         first_value(digest) over (partition by project, rel_path, fmt
                               order by split_part(manifest, '/', 1), manifest, position) as kept
  from normal where fmt is not null),
merged as (
  select project, rel_path, fmt, max(digest) filter (n = 1) as digest,
         count(*) filter (digest <> kept) as conflicts
  from ranked group by project, rel_path, fmt)"""


def _entries(fx: Fixtures) -> DataFrame:
    """Entries as manifests write them: names relative to the manifest, backslashes and dots."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    return fx["fx_legacy"].select(
        "project",
        "manifest",
        (F.col("doc_id") * 2).alias("position"),
        F.concat(F.lit("sub\\..\\./"), name).alias("name"),
        "tag",
        F.concat(F.lit(" "), F.upper("value"), F.lit(" ")).alias("value"),
    )


def _merged(fx: Fixtures) -> DataFrame:
    return origin.merge_origin(origin.normalise_origin(_entries(fx)))


def _expected(fx: Fixtures) -> DataFrame:
    """Origin digests of the format the views carry."""
    return _merged(fx).where(F.col("fmt") == "md5")


@query(
    FILES,
    """select c.project, c.rel_path, c.size, c.mtime_ns, f.fmt
       from fx_current c join (
         select project, rel_path, 'xxh128' as fmt from fx_current
         union
         select project, rel_path, fmt from merged) f
       on f.project = c.project and f.rel_path = c.rel_path""",
    ctes=NORMAL,
)
def wanted_formats(fx: Fixtures) -> DataFrame:
    return digests.wanted_formats(fx["fx_current"], _merged(fx))


@query(
    BOTH,
    """select c.project, c.rel_path, c.size, c.mtime_ns, 'md5' as fmt, s.digest
       from fx_current c left join fx_sealed s on s.project = c.project
        and s.rel_path = c.rel_path and s.size = c.size and s.mtime_ns = c.mtime_ns""",
)
def reuse_digests(fx: Fixtures) -> DataFrame:
    wanted = digests.wanted_formats(fx["fx_current"], _stored(fx).limit(0), primary="md5")
    return digests.reuse_digests(wanted, _stored(fx))


@query(
    FILES,
    """select project, rel_path, size, mtime_ns,
              'sha1' || coalesce(string_agg(fmt, '' order by fmt), '') as formats
       from (select c.*, case when m.fmt is not null and s.digest is null then ',' || m.fmt end as fmt
             from fx_current c
             left join (select project, rel_path, fmt from merged where fmt = 'xxh64') m
               on m.project = c.project and m.rel_path = c.rel_path
             left join fx_sealed s on false)
       group by project, rel_path, size, mtime_ns""",
    ctes=NORMAL,
)
def fresh_read(fx: Fixtures) -> DataFrame:
    """A verification asks for every format again, whatever is stored."""
    extra = _merged(fx).where(F.col("fmt") == "xxh64")
    wanted = digests.wanted_formats(fx["fx_current"], extra, primary="sha1")
    out = digests.fresh_read(wanted)
    return out.withColumn("formats", F.array_join("formats", ","))


@query(
    THREE,
    """select p.project, p.rel_path, p.size, p.mtime_ns from fx_sealed p
       where not exists (select 1 from fx_current c where c.project = p.project
         and c.rel_path = p.rel_path and c.size = p.size and c.mtime_ns = p.mtime_ns)""",
)
def changed_after_read(fx: Fixtures) -> DataFrame:
    out = digests.changed_after_read(fx["fx_sealed"], fx["fx_current"])
    return out.select("project", "rel_path", "size", "mtime_ns")


@query(
    BOTH,
    """select s.project, s.rel_path, s.digest from fx_sealed s join fx_current c
         on c.project = s.project and c.rel_path = s.rel_path and c.size = s.size
        and c.mtime_ns = s.mtime_ns
       where s.digest is not null""",
)
def prune_digests(fx: Fixtures) -> DataFrame:
    out = digests.prune_digests(_stored(fx), fx["fx_current"])
    return out.select("project", "rel_path", "digest")


@query(
    BOTH,
    """select project as item, count(done) as files_done, count(*) as files_total,
              cast(coalesce(sum(size) filter (done is not null), 0) as bigint) as bytes_done,
              cast(sum(size) as bigint) as bytes_total,
              least(100, cast(floor(coalesce(sum(size) filter (done is not null), 0) * 100 / sum(size))
                as bigint)) as percent
       from (select c.project, c.size, s.rel_path as done from fx_current c left join fx_sealed s
             on s.project = c.project and s.rel_path = c.rel_path)
       group by project""",
)
def read_progress(fx: Fixtures) -> DataFrame:
    items = fx["fx_current"].withColumnRenamed("project", "item")
    return digests.read_progress(items, fx["fx_sealed"].withColumnRenamed("project", "item"))


@query(
    ("fx_jobs",),
    """select id, case when files_total > 0
                       then least(100, cast(floor(files_done * 100 / files_total) as bigint))
                       else 0 end as percent
       from fx_jobs""",
)
def work_percent(fx: Fixtures) -> DataFrame:
    none = fx["fx_jobs"].withColumns({"bytes_done": F.lit(0), "bytes_total": F.lit(0)})
    percent = digests.progress_percent("bytes_done", "bytes_total", "files_done", "files_total")
    return none.select("id", percent.alias("percent"))


@query(
    ("fx_legacy",),
    "select project, manifest, rel_path, position, fmt, digest, warning from normal",
    ctes=NORMAL,
)
def normalise_origin(fx: Fixtures) -> DataFrame:
    return origin.normalise_origin(_entries(fx))


@query(("fx_legacy",), "select * from merged", ctes=NORMAL)
def merge_origin(fx: Fixtures) -> DataFrame:
    return _merged(fx)


@query(
    ("fx_legacy",),
    """select project, manifest, rel_path, fmt, digest, kept,
              split_part(manifest, '/', -1) || ': ' || rel_path || ': conflicting ' || fmt
              || ', kept first' as warning
       from ranked where digest <> kept""",
    ctes=NORMAL,
)
def origin_conflicts(fx: Fixtures) -> DataFrame:
    out = origin.origin_conflicts(origin.normalise_origin(_entries(fx)))
    return out.select("project", "manifest", "rel_path", "fmt", "digest", "kept", "warning")


PROBLEMS = """
expected as (select project, rel_path, fmt, digest from merged where fmt = 'md5'),
problems as (
  select e.project, e.rel_path,
         case when c.rel_path is null then 'deleted' else 'modified' end as change,
         c.size as new_size, c.mtime_ns as new_mtime_ns
  from expected e left join fx_current c on c.project = e.project and c.rel_path = e.rel_path
  where c.rel_path is null or (c.size % 10 <> 0 and c.digest <> e.digest))"""


@query(
    FILES,
    """select * from problems where change <> 'deleted' or (project, rel_path) not in (
         select project, rel_path from fx_sealed where size % 2 = 0)""",
    ctes=NORMAL + "," + PROBLEMS,
)
def origin_problems(fx: Fixtures) -> DataFrame:
    """Some files are not read, some absent ones are there but ignored."""
    current = fx["fx_current"]
    read = _md5_rows(current.where("size % 10 <> 0"))
    hidden = fx["fx_sealed"].where("size % 2 = 0")
    return origin.origin_problems(_expected(fx), current, read, hidden)


@query(
    FILES,
    """select c.project, c.rel_path, f.fmt from fx_current c
       cross join (select unnest(['md5', 'xxh128']) as fmt) f
       where f.fmt = 'xxh128' or not exists (
         select 1 from problems p where p.project = c.project and p.rel_path = c.rel_path
           and p.change = 'modified')""",
    ctes=NORMAL + "," + PROBLEMS,
)
def accept_overrides(fx: Fixtures) -> DataFrame:
    current = fx["fx_current"]
    found = origin.origin_problems(
        _expected(fx), current, _md5_rows(current.where("size % 10 <> 0"))
    )
    both = _md5_rows(current).unionByName(
        current.select("project", "rel_path", F.lit("xxh128").alias("fmt"), "digest")
    )
    return origin.accept_overrides(both, found).select("project", "rel_path", "fmt")


@query(
    FILES,
    """select project, rel_path, fmt, digest, conflicts from merged m
       where exists (select 1 from fx_current c where c.project = m.project and c.rel_path = m.rel_path)
         and not exists (select 1 from fx_sealed s where s.project = m.project
                         and s.rel_path = m.rel_path)""",
    ctes=NORMAL,
)
def append_scope(fx: Fixtures) -> DataFrame:
    rows = diff.diff_against_sealed(fx["fx_current"], fx["fx_sealed"])
    return origin.append_scope(_merged(fx), rows)


# --- generations -----------------------------------------------------------------------------

BY_ID = ("project_id",)
NEWEST = """
newest as materialized (select project_id, max(generation_no) as g from fx_gen_files group by project_id),
given as materialized (
  select f.project_id, f.rel_path, 'md5' as fmt, f.digest from fx_gen_files f
  join newest n on n.project_id = f.project_id and n.g = f.generation_no
  union all
  select f.project_id, f.rel_path, 'sha1', md5(f.digest) from fx_gen_files f
  join newest n on n.project_id = f.project_id and n.g = f.generation_no
  where starts_with(f.rel_path, 'd1/')
  union all
  select f.project_id, f.rel_path, 'xxh64', md5(f.digest) from fx_gen_files f
  join newest n on n.project_id = f.project_id and n.g = f.generation_no
  where starts_with(f.rel_path, 'd2/')),
firsts as materialized (
  select f.project_id, f.rel_path, min_by(f.digest, f.generation_no) as digest from fx_gen_files f
  join newest n on n.project_id = f.project_id and f.generation_no < n.g
  group by f.project_id, f.rel_path),
acted as materialized (
  select g.*, case when f.digest is null then case when g.fmt = 'sha1' then 'verified' else 'original' end
                   when g.fmt = 'md5' then case when g.digest = f.digest then 'verified' else 'failed' end
                   when m.digest = f.digest then 'verified' else 'failed' end as action
  from given g left join firsts f on f.project_id = g.project_id and f.rel_path = g.rel_path
  left join given m on m.project_id = g.project_id and m.rel_path = g.rel_path and m.fmt = 'md5')"""


@query(
    ("fx_gen_files",),
    """select *, case when action = 'failed' then 'hash mismatch' end as problem from acted""",
    ctes=NEWEST,
)
def assign_actions(fx: Fixtures) -> DataFrame:
    """The newest generation of each project against all earlier ones, with two more formats."""
    files = fx.staged("fx_gen_files")
    newest = files.groupBy("project_id").agg(F.max("generation_no").alias("generation_no"))
    one = ["project_id", "generation_no"]
    last = files.join(newest, one, "left_semi")
    history = files.join(newest, one, "left_anti").select(
        "project_id", "rel_path", "generation_no", F.lit("md5").alias("fmt"), "digest"
    )

    def as_format(df: DataFrame, fmt: str, digest: Column) -> DataFrame:
        return df.select("project_id", "rel_path", F.lit(fmt).alias("fmt"), digest.alias("digest"))

    given = (
        as_format(last, "md5", F.col("digest"))
        .unionByName(
            as_format(last.where(F.col("rel_path").startswith("d1/")), "sha1", F.md5("digest"))
        )
        .unionByName(
            as_format(last.where(F.col("rel_path").startswith("d2/")), "xxh64", F.md5("digest"))
        )
    )
    return generations.assign_actions(given, history, ["sha1"], BY_ID)


def _sealed_history(fx: Fixtures) -> DataFrame:
    return _md5_rows(fx["fx_sealed"].where(F.col("digest").isNotNull())).withColumn(
        "generation_no", F.lit(1)
    )


@query(
    THREE,
    """select project,
              count(*) filter (p and not g) as without_digest, count(*) filter (g and not p) as not_on_disk,
              count(*) filter (r and not p) as gone, cast(0 as bigint) as lacks_format,
              count(*) filter (f) as failures,
              count(*) filter ((p and not g) or (g and not p) or (r and not p) or f) = 0 as complete
       from (select project, rel_path, bool_or(g) as g, bool_or(p) as p, bool_or(r) as r, bool_or(f) as f
             from (select project, rel_path, true as g, false as p, false as r, false as f
                   from fx_current where size % 5 <> 0
                   union all select project, rel_path, false, true, false, false from fx_previous
                   union all select project, rel_path, false, false, true, false from fx_sealed
                   union all select c.project, c.rel_path, false, false, false, true
                     from fx_current c join fx_sealed s on s.project = c.project
                      and s.rel_path = c.rel_path and s.digest <> c.digest
                     where c.size % 5 <> 0)
             group by project, rel_path)
       group by project""",
)
def completeness_check(fx: Fixtures) -> DataFrame:
    given = _md5_rows(fx["fx_current"].where("size % 5 <> 0"))
    actions = generations.assign_actions(given, _sealed_history(fx))
    return generations.completeness_check(
        given, fx["fx_previous"], fx["fx_sealed"], actions, "md5"
    )


@query(
    THREE,
    """select d.project, d.rel_path, 'md5' as fmt, c.digest, 'original' as action,
              cast(null as varchar) as problem, false as is_full
       from diff d join fx_current c on c.project = d.project and c.rel_path = d.rel_path
       where d.change = 'added'""",
    ctes=DIFF,
)
def partial_generation(fx: Fixtures) -> DataFrame:
    rows = diff.diff_against_sealed(fx["fx_current"], fx["fx_sealed"])
    return generations.partial_generation(
        _md5_rows(fx["fx_current"]), rows.where(F.col("change") == "added"), _sealed_history(fx)
    )


ROLLUP = """
leaf as (
  select project, split_part(rel_path, '/', 1) as dir,
         md5(unhex(string_agg(digest, '' order by digest))) as content,
         md5(unhex(string_agg(named, '' order by named))) as structure
  from (select *, md5(encode(split_part(rel_path, '/', 2)) || unhex(digest)) as named from fx_current)
  group by 1, 2),
root as (
  select project, md5(unhex(string_agg(content, '' order by content))) as content,
         md5(unhex(string_agg(named, '' order by named))) as structure
  from (select *, md5(encode(dir) || unhex(structure)) as named from leaf)
  group by 1)"""
ROLLUP_SQL = """select project, dir as rel_path, content, structure from leaf
       union all select project, '', content, structure from root"""


@query(("fx_current",), ROLLUP_SQL, ctes=ROLLUP)
def directory_hashes(fx: Fixtures) -> DataFrame:
    return rollup.directory_hashes(fx["fx_current"].select("project", "rel_path", "digest"), "md5")


@query(
    ("fx_generations",),
    """select project_id, cast(max(generation_no) + 1 as int) as generation_no,
              printf('%04d_%s_%sZ.mhl', max(generation_no) + 1, cast(project_id as varchar),
                     strftime(max(created_at), '%Y-%m-%d_%H%M%S')) as manifest
       from fx_generations group by project_id""",
)
def number_generations(fx: Fixtures) -> DataFrame:
    chain = fx["fx_generations"]
    pending = chain.groupBy("project_id").agg(F.max("created_at").alias("created_at"))
    out = generations.number_generations(pending, chain, BY_ID)
    return out.select("project_id", "generation_no", "manifest")


HISTORY = """
bounds as (
  select *, coalesce(max(case when is_full then generation_no end) over (
           partition by project_id order by generation_no
           rows between unbounded preceding and 1 preceding), 0) as since
  from fx_generations),
known as (
  select b.project_id, b.generation_no, f.rel_path, max_by(f.digest, f.generation_no) as digest
  from bounds b join fx_gen_files f on f.project_id = b.project_id
   and f.generation_no >= b.since and f.generation_no < b.generation_no
  group by 1, 2, 3),
sides as (
  select coalesce(l.project_id, k.project_id) as project_id,
         coalesce(l.generation_no, k.generation_no) as generation_no,
         l.rel_path is not null as listed, k.rel_path is not null as was_known,
         l.digest <> k.digest as differs
  from fx_gen_files l full join known k on k.project_id = l.project_id
   and k.generation_no = l.generation_no and k.rel_path = l.rel_path),
steps as (
  select b.project_id, b.generation_no, b.is_full,
         count(*) filter (s.listed) as files,
         count(*) filter (s.listed and not s.was_known) as new,
         count(*) filter (s.listed and s.was_known and s.differs) as modified,
         count(*) filter (b.is_full and not s.listed and s.was_known) as removed
  from bounds b left join sides s on s.project_id = b.project_id and s.generation_no = b.generation_no
  where b.generation_no > 1 group by 1, 2, 3)"""


def _gen_entries(fx: Fixtures) -> DataFrame:
    return fx["fx_gen_files"].select(
        "project_id", "generation_no", "rel_path", F.lit("md5").alias("fmt"), "digest"
    )


@query(
    ("fx_gen_files",),
    """select *, coalesce(nullif(concat_ws(' · ', case when new > 0 then '+' || new || ' new' end,
              case when modified > 0 then modified || ' modified' end,
              case when removed > 0 then removed || ' removed' end), ''), 'no changes') as changes
       from steps""",
    ctes=HISTORY,
)
def history_diff(fx: Fixtures) -> DataFrame:
    entries = _gen_entries(fx)
    return generations.history_diff(fx.spark.table("fx_generations"), entries, BY_ID)


@query(
    ("fx_gen_files",),
    """select f.project_id, f.rel_path, cast(max(f.generation_no) as int) as generation_no,
              max_by(f.digest, f.generation_no) as digest
       from fx_gen_files f join (
         select project_id, coalesce(max(generation_no) filter (is_full), 0) as since
         from fx_generations group by 1) g
       on g.project_id = f.project_id and f.generation_no >= g.since
       group by 1, 2""",
)
def current_from_history(fx: Fixtures) -> DataFrame:
    entries = _gen_entries(fx)
    return generations.current_from_history(fx.spark.table("fx_generations"), entries, BY_ID)


MANIFESTS = """
manifests as (
  select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as project,
         split_part(path, '/', -1) as manifest,
         cast(regexp_extract(path, '_([0-9]+)[.]mhl$', 1) as int) as number
  from fx_archive where regexp_matches(path, '^2024/src[0-9]+/ascmhl/'))"""


@query(
    ("fx_archive",),
    "select project, manifest from manifests where number % 2 = 1",
    ctes=MANIFESTS,
)
def orphan_manifests(fx: Fixtures) -> DataFrame:
    from keepsake.operators.discovery import with_project

    listing = with_project(fx["fx_archive"])
    number = F.regexp_extract("rel_path", "_([0-9]+)[.]mhl$", 1).try_cast("int")
    chain = listing.where(number % 2 == 0).select(
        "project", F.col("rel_path").alias("manifest")
    )
    return generations.orphan_manifests(listing, chain)


REFERENCED = """
latest as (
  select project_id, max(generation_no) as g, max_by(gen_key, generation_no) as k
  from fx_generations group by 1),
referenced as (
  select p.id, p.rel_path,
         p.rel_path || '/ascmhl/' || printf('%04d_a.mhl', l.g) as manifest,
         md5(cast(l.k as varchar)) as c4
  from fx_projects p join latest l on l.project_id = p.id
  where p.last_generation_no is not null and p.state not in ('ignored', 'missing')
    and p.id % 10 <> 0)"""
ARCHIVE = ("fx_projects", "fx_generations")


def _referenced(fx: Fixtures) -> DataFrame:
    projects = fx["fx_projects"]
    rows = fx["fx_generations"].select(
        F.col("project_id").alias("id"),
        "generation_no",
        F.format_string("%04d_a.mhl", "generation_no").alias("manifest"),
        F.md5(F.col("gen_key").cast("string")).alias("c4"),
    )
    on_disk = projects.where("id % 10 <> 0").select("id")
    return generations.archive_references(projects, rows, on_disk)


@query(ARCHIVE, "select * from referenced", ctes=REFERENCED)
def archive_references(fx: Fixtures) -> DataFrame:
    return _referenced(fx)


@query(
    ARCHIVE,
    """select count(n.rel_path) as referenced, count(*) filter (r.rel_path is null) as to_add,
              count(*) filter (n.rel_path is null) as to_drop,
              count(n.rel_path) > 0 and count(*) filter (r.rel_path is null or n.rel_path is null) > 0
                as needed
       from referenced n full join (
         select rel_path from fx_projects where id % 4 <> 1 and last_generation_no is not null) r
       on r.rel_path = n.rel_path""",
    ctes=REFERENCED,
)
def references_stale(fx: Fixtures) -> DataFrame:
    recorded = fx["fx_projects"].where("id % 4 <> 1 and last_generation_no is not null")
    return generations.references_stale(_referenced(fx), recorded, False, True)


@query(
    ("fx_archive",),
    """select replace(path, '0001_', '0002_') as path from fx_archive
       where regexp_matches(path, '/ascmhl/0001_[0-9]*[02468][.]mhl$')""",
)
def dangling_references(fx: Fixtures) -> DataFrame:
    """Every second reference names a generation that is not on disk."""
    manifests = fx["fx_archive"].where(F.col("path").rlike("/ascmhl/0001_[0-9]+[.]mhl$"))
    gone = F.col("path").rlike("[02468][.]mhl$")
    references = manifests.select(
        F.when(gone, F.replace("path", F.lit("0001_"), F.lit("0002_")))
        .otherwise(F.col("path"))
        .alias("path")
    )
    return generations.dangling_references(references, fx["fx_archive"])


SYNC_VIEWS = """
source as (
  select project_id, concat(lpad(cast(generation_no as string), 4, '0'), '_a.mhl') as name,
         md5(cast(gen_key as string)) as content_id from fx_generations
  union all
  select project_id, 'ascmhl_chain.xml', md5(cast(max(gen_key) as string)) from fx_generations
  group by project_id),
stored as (
  select project_id, name,
         case when name = 'ascmhl_chain.xml' then md5('old') else content_id end as content_id,
         1 as epoch, false as superseded
  from source where name < '0003' or (name = 'ascmhl_chain.xml' and project_id % 2 = 0)
  union all
  select project_id, '0009_other.mhl', md5('other'), 1, false from source
  where name = '0001_a.mhl' and project_id % 5 = 0)"""


@query(
    ("fx_generations",),
    """select project_id, name, content_id, 1 as epoch, true as superseded from stored
       where project_id % 5 = 0
       union all
       select project_id, name, content_id, case when project_id % 5 = 0 then 2 else 1 end, false
       from source""",
    ctes=SYNC_VIEWS,
)
def sync_history(fx: Fixtures) -> DataFrame:
    """A fifth of the copies belong to another history and are set aside."""
    source = fx.sql(f"with {SYNC_VIEWS} select * from source", "fx_generations")
    stored = fx.sql(f"with {SYNC_VIEWS} select * from stored", "fx_generations")
    return generations.sync_history(stored, source, BY_ID)


@query(
    ("fx_generations",),
    f"""select project_id, generation_no,
               case when project_id % 4 = 1 then {NOW} end as superseded_at
        from fx_generations""",
)
def supersede_history(fx: Fixtures) -> DataFrame:
    live = fx["fx_generations"].withColumn("superseded_at", F.lit(None).cast("timestamp"))
    accepted = live.where("project_id % 4 = 1").select("project_id")
    out = generations.supersede_history(live, accepted, now(), BY_ID)
    return out.select("project_id", "generation_no", "superseded_at")


# --- whole jobs ------------------------------------------------------------------------------

LATER = "cast(substr(project, 4) as int) >= 10"
SEAL = f"""
expected as (select * from merged where fmt = 'md5' and {LATER}),
blocking as (
  select e.project, e.rel_path from expected e left join fx_current c
    on c.project = e.project and c.rel_path = e.rel_path
  where c.rel_path is null or c.digest <> e.digest),
legacy_reasons as (
  select project, count(*) || ' files do not match their legacy MHL 1.x: '
         || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end as reason
  from (select *, row_number() over (partition by project order by rel_path) as n from blocking)
  group by project)"""


def _read_rows(fx: Fixtures, expected: DataFrame) -> DataFrame:
    """Digests of a read: the primary format of every file, and what its origin recorded.

    The views carry one digest per file; it stands for both.
    """
    current = fx["fx_current"].select("project", "rel_path", "digest")
    listed = expected.select("project", "rel_path", "fmt")
    return current.withColumn("fmt", F.lit("xxh128")).unionByName(
        current.join(listed, ["project", "rel_path"])
    )


def _jobs_expected(fx: Fixtures) -> DataFrame:
    """Half of the projects came with origin manifests."""
    return _expected(fx).where(LATER)


@query(
    FILES,
    f"""select c.project, case when r.reason is null then 'sealed' else 'needs_review' end as state,
               r.reason as review_reason, r.reason is null as writes_generation,
               count(*) as files, cast(sum(c.size) as bigint) as bytes
        from fx_current c left join legacy_reasons r on r.project = c.project group by 1, 2, 3, 4""",
    ctes=NORMAL + "," + SEAL,
)
def seal(fx: Fixtures) -> DataFrame:
    current = fx["fx_current"]
    history = _md5_rows(current.limit(0)).withColumn("generation_no", F.lit(1))
    expected = _jobs_expected(fx)
    return jobs.seal(current, _read_rows(fx, expected), expected, history).outcome


@query(
    FILES,
    """select c.project, c.rel_path, 'xxh128' as fmt, c.digest, 'original' as action
       from fx_current c
       where c.project not in (select project from legacy_reasons)
       union all
       select c.project, c.rel_path, 'md5', c.digest, 'verified'
       from fx_current c join expected e on e.project = c.project and e.rel_path = c.rel_path
       where c.project not in (select project from legacy_reasons)""",
    ctes=NORMAL + "," + SEAL,
)
def seal_entries(fx: Fixtures) -> DataFrame:
    current = fx["fx_current"]
    history = _md5_rows(current.limit(0)).withColumn("generation_no", F.lit(1))
    expected = _jobs_expected(fx)
    return jobs.seal(current, _read_rows(fx, expected), expected, history).entries


APPEND = """
fewer as (
  select s.* from fx_sealed s join fx_current c on c.project = s.project and c.rel_path = s.rel_path
  where cast(substr(s.project, 4) as int) < 12 and s.size = c.size
    and abs(s.mtime_ns - c.mtime_ns) <= 1000000000
  union all
  select s.* from fx_sealed s where cast(substr(s.project, 4) as int) >= 12),
changed as (
  select coalesce(c.project, s.project) as project, coalesce(c.rel_path, s.rel_path) as rel_path,
         case when s.rel_path is null then 'added' when c.rel_path is null then 'deleted'
              when c.size <> s.size or abs(c.mtime_ns - s.mtime_ns) > 1000000000 then 'modified' end
           as change
  from fx_current c full join fewer s on s.project = c.project and s.rel_path = c.rel_path),
diff_reasons as (
  select project,
         concat_ws(' and ',
           case when count(*) filter (change = 'modified') > 0
                then count(*) filter (change = 'modified') || ' modified' end,
           case when count(*) filter (change = 'deleted') > 0
                then count(*) filter (change = 'deleted') || ' deleted' end)
         || ' since the last seal: ' || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end as reason
  from (select *, row_number() over (partition by project order by rel_path) as n
        from changed where change in ('modified', 'deleted'))
  group by project),
added as (select project, rel_path from changed where change = 'added'
            and project not in (select project from diff_reasons)),
bad_origin as (
  select a.project, a.rel_path from added a
  join merged m on m.project = a.project and m.rel_path = a.rel_path and m.fmt = 'md5'
  join fx_current c on c.project = a.project and c.rel_path = a.rel_path
  where c.digest <> m.digest),
append_reasons as (
  select * from diff_reasons
  union all
  select project, count(*) || ' files do not match their legacy MHL 1.x: '
         || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end
  from (select *, row_number() over (partition by project order by rel_path) as n from bad_origin)
  group by project)"""


def _kept_record(fx: Fixtures) -> DataFrame:
    """Projects below 12 were sealed without the files that differ now."""
    sealed, current = fx["fx_sealed"], fx["fx_current"]
    rows = diff.diff_against_sealed(current, sealed).where("change = 'unchanged'")
    early = F.expr("substring(project, 4)").cast("int") < 12
    return (
        sealed.where(early)
        .join(rows.select("project", "rel_path"), ["project", "rel_path"], "left_semi")
        .unionByName(sealed.where(~early))
    )


@query(
    FILES,
    """select c.project, case when r.reason is null then 'sealed' else 'needs_review' end as state,
              r.reason as review_reason, r.reason is null and coalesce(a.n, 0) > 0 as writes_generation,
              count(*) as files, cast(sum(c.size) as bigint) as bytes, coalesce(a.n, 0) as added
       from fx_current c left join append_reasons r on r.project = c.project
       left join (select project, count(*) as n from added group by 1) a on a.project = c.project
       group by c.project, r.reason, a.n""",
    ctes=NORMAL + "," + APPEND,
)
def append(fx: Fixtures) -> DataFrame:
    current, sealed, expected = fx["fx_current"], _kept_record(fx), _expected(fx)
    history = _md5_rows(sealed).withColumn("generation_no", F.lit(1))
    return jobs.append(current, sealed, _read_rows(fx, expected), expected, history).outcome


@query(
    FILES,
    """select c.project, 'sealed' as state, cast(null as varchar) as review_reason,
              true as writes_generation, count(*) as files, cast(sum(c.size) as bigint) as bytes,
              coalesce(b.n, 0) as overridden,
              case when c.project in (select project from fx_sealed) then 2 else 1 end as epoch,
              1 as generation_no
       from fx_current c left join (select project, count(*) as n from blocking group by 1) b
         on b.project = c.project
       group by c.project, b.n""",
    ctes=NORMAL + "," + SEAL,
)
def accept_new_version(fx: Fixtures) -> DataFrame:
    current = fx["fx_current"]
    old = (
        fx["fx_sealed"]
        .select("project")
        .distinct()
        .withColumns(
            {
                "generation_no": F.lit(1),
                "epoch": F.lit(1),
                "superseded_at": F.lit(None).cast("timestamp"),
            }
        )
    )
    expected = _jobs_expected(fx)
    result, _ = jobs.accept_new_version(
        current, _read_rows(fx, expected), expected, old, now()
    )
    return result.outcome
