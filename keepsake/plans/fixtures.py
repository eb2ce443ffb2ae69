"""The archive views derived from the given tables, for Spark and, as text, for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from keepsake.operators.running import number_rows
from keepsake.schemas import TABLES
from keepsake.session import prepare, stage

NOW = "timestamp '1998-06-01 12:00:00'"

_DOC_PATH = (
    "concat(lang, '/', cast(doc_id as string), case doc_id % 4 when 0 then '.mov'"
    " when 1 then '.EXR' when 2 then '.wav' else '' end)"
)

VIEWS: dict[str, str] = {
    "fx_current": f"""
select source as project, {_DOC_PATH} as rel_path, n_chars as size,
       cast(1700000000000000000 + doc_id * 60000000000
            + case when doc_id % 11 = 0 then 5000000000
                   when doc_id % 31 = 0 then 1000000000 else 0 end as bigint) as mtime_ns,
       md5(text) as digest
from documents where doc_id % 17 <> 3""",
    "fx_previous": """
select project, rel_path, size, mtime_ns from fx_current
where cast(substr(project, 4) as int) < 10 or size % 7 <> 0""",
    "fx_sealed": f"""
select source as project, {_DOC_PATH} as rel_path,
       n_chars + case when doc_id % 13 = 5 then 1 else 0 end as size,
       cast(1700000000000000000 + doc_id * 60000000000 as bigint) as mtime_ns,
       case when doc_id % 97 = 1 then null
            when doc_id % 19 = 7 then md5(concat(text, 'x')) else md5(text) end as digest
from documents where doc_id % 23 <> 4 and source <> 'src19'""",
    "fx_archive": """
select case when doc_id % 37 = 0 then concat('_RESOURCES/', source, '/', cast(doc_id as string), '.png')
            when doc_id % 41 = 0 then concat('2024/@Recycle/', cast(doc_id as string), '.mov')
            when doc_id % 43 = 0 then concat('2024/notes_', cast(doc_id as string), '.txt')
            when doc_id % 47 = 0 then concat('2024/', source, '/ascmhl/0001_', cast(doc_id as string), '.mhl')
            when doc_id % 53 = 0 then concat('2024/', source, '/', lang, '/._', cast(doc_id as string))
            else concat('20', cast(24 + doc_id % 2 as string), '/', source, '/', lang, '/',
                        cast(doc_id as string), '.mov') end as path,
       n_chars as size,
       case when doc_id % 59 = 0 then 'symlink' else 'file' end as kind
from documents""",
    "fx_projects": """
select c_custkey as id,
       concat('20', lpad(cast(c_nationkey as string), 2, '0'), '/', c_name) as rel_path,
       c_name as name,
       case c_custkey % 9 when 0 then 'unsealed' when 1 then 'queued' when 2 then 'hashing'
            when 3 then 'sealed' when 4 then 'changed' when 5 then 'needs_review'
            when 6 then 'ignored' when 7 then 'missing' else 'sealed' end as state,
       case when c_custkey % 9 = 0 then null else 1 + c_custkey % 4 end as last_generation_no,
       timestamp '1994-01-01 00:00:00' as first_seen,
       o.sealed_at as last_sealed_at,
       case when c_custkey % 2 = 0 then o.verified_at end as last_verified_at,
       o.file_count, o.total_bytes
from customer left join (
  select o_custkey, min(o_orderdate) as sealed_at, max(o_orderdate) as verified_at,
         count(*) as file_count, cast(sum(floor(o_totalprice)) as bigint) as total_bytes
  from orders group by o_custkey) o on o.o_custkey = c_custkey""",
    "fx_known": """
select p.*, id % 3 = 0 as preexisting,
       case when state = 'missing' and id % 2 = 0 then timestamp '1998-05-01 08:00:00'
            when state = 'missing' then timestamp '1998-05-20 08:00:00' end as missing_since,
       case when state = 'missing' then case id % 4 when 0 then 'changed' when 1 then 'queued'
            when 2 then 'needs_review' end end as state_before_missing,
       case when state = 'needs_review' then
            case id % 3 when 0 then 'verification: 1 corrupt; files: a.mov'
                        when 1 then '2 deleted since the last seal: b.mov, c.mov' end
       end as review_reason,
       timestamp '1998-05-31 00:00:00' as last_scan_at,
       case when id % 5 <> 0 then timestamp '1998-05-30 00:00:00' end as last_change_at,
       case when id % 4 <> 0 then timestamp '1998-05-30 00:00:00' end as stable_since
from fx_projects p""",
    "fx_listing": """
select rel_path, name from fx_projects where id % 11 <> 3 and (state <> 'missing' or id % 2 = 1)
union all
select concat(rel_path, ' new') as rel_path, concat(name, ' new') as name
from fx_projects where id % 13 = 1""",
    "fx_listing_errors": """
select concat('20', lpad(cast(n_nationkey as string), 2, '0')) as path
from nation where n_nationkey % 6 = 3""",
    "fx_generations": """
select o_custkey as project_id, o_orderkey as gen_key, o_orderdate as created_at,
       cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int)
         as generation_no,
       (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1
        or o_orderkey % 3 <> 0) as is_full
from orders""",
    "fx_gen_files": """
select project_id, generation_no, is_full, rel_path, min(digest) as digest
from (select g.project_id, g.generation_no, g.is_full,
             concat('d', cast(l_partkey % 5 as string), '/p', cast(l_partkey % 40 as string)) as rel_path,
             md5(cast(cast(l_quantity as int) % 3 as string)) as digest
      from fx_generations g join lineitem on l_orderkey = g.gen_key) x
group by project_id, generation_no, is_full, rel_path""",
    "fx_jobs": """
select event_id + 1 as id, user_id as project_id,
       case event_type when 'signup' then 'seal' when 'error' then 'append' when 'click' then 'verify'
            when 'view' then 'accept_new_version' else 'root_manifest' end as kind,
       case when event_id % 3 = 0 then 'manual' else 'auto' end as trigger_kind,
       case event_id % 10 when 0 then 'queued' when 1 then 'running' when 2 then 'failed'
            when 3 then 'cancelled' else 'done' end as state,
       case event_type when 'signup' then 30 when 'view' then 30 when 'error' then 20
            when 'click' then 10 else 5 end
         + case when event_id % 3 = 0 then 100 else 0 end as priority,
       ts as created_at, ts + interval 2 hour as finished_at,
       cast(floor(value) as bigint) as files_done, 20 as files_total
from events""",
    "fx_requests": """
select j.*, id % 7 = 0 as bypass_hours from fx_jobs j""",
    "fx_decisions": """
select id, case id % 8 when 0 then 'seal' when 1 then 'cancel' when 2 then 'start_now'
           when 3 then 'verify_now' when 4 then 'update_now' when 5 then 'accept'
           when 6 then 'unignore' else 'ignore' end as action
from fx_projects
union all
select id, 'postpone' as action from fx_projects where id % 9 = 5""",
    "fx_legacy": f"""
select source as project, concat(lang, '/A.mhl') as manifest, {_DOC_PATH} as rel_path, doc_id,
       'md5' as tag,
       case when doc_id % 29 = 2 then upper(md5(concat(text, 'y'))) else md5(text) end as value
from documents where doc_id % 5 = 0
union all
select source, concat(lang, '/B.mhl'), {_DOC_PATH}, doc_id,
       case doc_id % 3 when 0 then 'md5' when 1 then 'xxhash64' else 'xxhash' end,
       substr(md5(text), 1, 16)
from documents where doc_id % 10 = 0""",
}

DEPENDS = {
    "fx_previous": ("fx_current",),
    "fx_known": ("fx_projects",),
    "fx_listing": ("fx_projects",),
    "fx_gen_files": ("fx_generations",),
    "fx_requests": ("fx_jobs",),
    "fx_decisions": ("fx_projects",),
}
READS = {
    "fx_current": ("documents",),
    "fx_sealed": ("documents",),
    "fx_archive": ("documents",),
    "fx_projects": ("customer", "orders"),
    "fx_listing_errors": ("nation",),
    "fx_generations": ("orders",),
    "fx_gen_files": ("lineitem",),
    "fx_jobs": ("events",),
    "fx_legacy": ("documents",),
}


def closure(names: tuple[str, ...]) -> list[str]:
    """``names`` and what they build on, in order of definition."""
    wanted = set(names)
    while more := {d for n in wanted for d in DEPENDS.get(n, ())} - wanted:
        wanted |= more
    return [v for v in VIEWS if v in wanted]


def as_ctes(names: tuple[str, ...]) -> str:
    """The views as the head of one SQL statement."""
    parts = [f"{v} as ({VIEWS[v]})" for v in closure(names)]
    return ("with " + ",\n".join(parts) + "\n") if parts else ""


class Fixtures:
    """Lazy access to the given tables and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self._defined: set[str] = set()

    def table(self, name: str) -> DataFrame:
        """A given table; its zone-less times are UTC instants."""
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        casts = [
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, TimestampNTZType)
            else F.col(f.name)
            for f in df.schema
        ]
        return df.select(*casts)

    def __getitem__(self, name: str) -> DataFrame:
        views = [v for v in closure((name,)) if v not in self._defined]
        tables = dict.fromkeys(t for v in views for t in READS.get(v, ()))
        for table in [t for t in tables if t not in self._defined]:
            self.table(table).createOrReplaceTempView(table)
        for view in views:
            df = self._generations() if view == "fx_generations" else self.spark.sql(VIEWS[view])
            df.createOrReplaceTempView(view)
        self._defined.update(views, tables)
        return self.spark.table(name)

    def staged(self, name: str) -> DataFrame:
        """A view that a query reads several times: a stored table anywhere but here."""
        df = stage(self[name])
        df.createOrReplaceTempView(name)
        return df

    def sql(self, text: str, *names: str) -> DataFrame:
        for name in names:
            self[name]
        return self.spark.sql(text)

    def _generations(self) -> DataFrame:
        """The view's numbering without a window per project."""
        numbered = number_rows(
            self.spark.table("orders").select("o_custkey", "o_orderdate", "o_orderkey"),
            ["o_custkey"],
            ["o_orderdate", "o_orderkey"],
            "n",
        )
        return numbered.select(
            F.col("o_custkey").alias("project_id"),
            F.col("o_orderkey").alias("gen_key"),
            F.col("o_orderdate").alias("created_at"),
            F.col("n").cast("int").alias("generation_no"),
            ((F.col("n") == 1) | (F.col("o_orderkey") % 3 != 0)).alias("is_full"),
        )
