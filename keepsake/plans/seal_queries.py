"""The whole seal: documents as files, read, sealed, changed, and sealed onto their history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import discovery
from keepsake.plans.fixtures import _DOC_PATH, Fixtures
from keepsake.plans.registry import query
from keepsake.plans.source_queries import _once
from keepsake.plans.whole_seal import Maker, seal_archive
from keepsake.session import new_folder
from keepsake.sources import export, inventory
from keepsake.sources.tables import TableSet

# The first seal finds what was there, the second what came later and what was written over.
STATES = f"""
archive as (
  select doc_id, source as project, {_DOC_PATH} as rel_path, coalesce(text, '') as text,
         doc_id % 7 <> 2 as was_there,
         doc_id % 31 = 5 and cast(substr(source, 4) as int) % 3 = 0 as written_over
  from documents),
states as (
  select 1 as run_no, project, rel_path, text, false as bad from archive where was_there
  union all
  select 2, project, rel_path, case when written_over then concat(text, 'x') else text end,
         was_there and written_over
  from archive)"""

SEALED_SQL = """
reviews as (
  select project, 'hash mismatch (review, not a generation): '
         || string_agg(rel_path, ', ' order by rel_path) filter (n <= 10)
         || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end as reason
  from (select *, row_number() over (partition by project order by rel_path) as n
        from states where bad)
  group by project),
written as (
  select s.run_no, s.project, s.rel_path, md5(s.text) as digest,
         case when s.run_no = 2 and f.rel_path is not null then 'verified' else 'original' end as action
  from states s left join states f
    on f.run_no = 1 and f.project = s.project and f.rel_path = s.rel_path
  where s.run_no = 1 or s.project not in (select project from reviews)),
leaf as (
  select run_no, project, split_part(rel_path, '/', 1) as dir,
         md5(unhex(string_agg(digest, '' order by digest))) as content,
         md5(unhex(string_agg(named, '' order by named))) as structure
  from (select *, md5(encode(split_part(rel_path, '/', 2)) || unhex(digest)) as named from written)
  group by 1, 2, 3),
root as (
  select run_no, project, md5(unhex(string_agg(content, '' order by content))) as content,
         md5(unhex(string_agg(named, '' order by named))) as structure
  from (select *, md5(encode(dir) || unhex(structure)) as named from leaf)
  group by 1, 2),
numbered as (
  select run_no, project, cast(row_number() over (partition by project order by run_no) as int)
           as generation_no
  from (select distinct run_no, project from written))"""


# A file of the second state that already lies there with these bytes.
_AS_IT_WAS = "(was_there and not coalesce(written_over, false))"


def _write(fx: Fixtures, root: str, number: int) -> None:
    """Bring the archive into its state before a run.

    Before the second, what came later or is written over is written. Every other file is touched:
    it has those bytes already, and with its new mtime no stored digest stands for it, so the run
    reads it again. Writing all of them over each other grew faster than the archive.
    """
    fx.table("documents").createOrReplaceTempView("documents")

    def run(act: Callable[[DataFrame, str], DataFrame], columns: str, where: str) -> None:
        rows = fx.spark.sql(
            f"with {STATES} select concat(project, '/', rel_path) as path{columns} where {where}"
        )
        act(rows, root).write.format("noop").mode("overwrite").save()

    content = ", encode({}, 'UTF-8') as content from {}"
    if number == 1:
        run(export.write_contents, content.format("text", "states"), "run_no = 1")
        return
    text = "case when written_over then concat(text, 'x') else text end"
    run(export.touch_files, " from archive", f"coalesce({_AS_IT_WAS}, false)")
    run(export.write_contents, content.format(text, "archive"), f"not coalesce({_AS_IT_WAS}, false)")


def _sealed_twice(fx: Fixtures) -> TableSet:
    return _once(fx, "sealed twice", lambda: _seal_twice(fx))


def _seal_twice(fx: Fixtures) -> TableSet:
    root, store = new_folder(fx.spark, "archive"), TableSet(fx.spark, new_folder(fx.spark, "seals"))

    def files() -> DataFrame:
        listing = inventory.read_inventory(fx.spark, root, depth=0)
        inside = discovery.apply_ignore_patterns(discovery.with_project(listing, depth=0))
        return discovery.regular_files(inside)

    for number in (1, 2):
        _write(fx, root, number)
        seal_archive(
            fx.spark, root, files, store, f"{store.path}/manifests", f"seal-{number}",
            F.lit(f"1998-06-0{number} 12:00:00").cast("timestamp"), Maker("host"), primary="md5",
        )
    return store


@query(
    (),
    """select s.run_no, s.project,
              case when n.project is null then 'needs_review' else 'sealed' end as state,
              case when n.project is null then r.reason end as review_reason,
              n.generation_no,
              printf('%04d_%s_1998-06-0%d_120000Z.mhl', n.generation_no, n.project, s.run_no) as manifest,
              s.files, s.bytes, coalesce(w.originals, 0) as originals, coalesce(w.verified, 0) as verified,
              root.content, root.structure
       from (select run_no, project, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes
             from states group by 1, 2) s
       left join numbered n on n.run_no = s.run_no and n.project = s.project
       left join reviews r on r.project = s.project
       left join (select run_no, project, count(*) filter (action = 'original') as originals,
                         count(*) filter (action = 'verified') as verified
                  from written group by 1, 2) w on w.run_no = s.run_no and w.project = s.project
       left join root on root.run_no = s.run_no and root.project = s.project""",
    ctes=STATES + "," + SEALED_SQL,
)
def seal_whole(fx: Fixtures) -> DataFrame:
    """Each project's outcome of both runs, with what was recorded and its root hash."""
    store = _sealed_twice(fx)
    key = ["run_no", "project"]
    actions = store.read_all("entries").groupBy(*key).agg(
        F.count_if(F.col("action") == "original").alias("originals"),
        F.count_if(F.col("action") == "verified").alias("verified"),
    )
    roots = store.read_all("folders").where(F.col("rel_path") == "")
    none = F.lit(0)
    return (
        store.read_all("outcome")
        .join(actions, key, "left")
        .join(roots.select(*key, "content", "structure"), key, "left")
        .select(
            *key, "state", "review_reason", "generation_no", "manifest", "files", "bytes",
            F.coalesce("originals", none).alias("originals"),
            F.coalesce("verified", none).alias("verified"),
            "content", "structure",
        )
    )


@query(
    (),
    """select n.generation_no, w.project, w.rel_path, 'md5' as fmt, w.digest, w.action
       from written w join numbered n on n.run_no = w.run_no and n.project = w.project""",
    ctes=STATES + "," + SEALED_SQL,
)
def seal_whole_entries(fx: Fixtures) -> DataFrame:
    """What the manifests record, generation by generation."""
    return _sealed_twice(fx).read_all("entries").select(
        "generation_no", "project", "rel_path", "fmt", "digest", "action"
    )
