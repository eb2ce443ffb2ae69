"""Reading and writing: files, manifests, chains and tables made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.paths import basename
from keepsake.operators import digests, discovery, generations, rollup
from keepsake.plans.fixtures import Fixtures
from keepsake.plans.history_queries import ROLLUP, ROLLUP_SQL, _referenced, ARCHIVE, REFERENCED
from keepsake.plans.registry import query
from keepsake.plans.scan_queries import now
from keepsake.session import new_folder, stage_table
from keepsake.sources import export, histories, inventory, manifests, tables

_WRITTEN: dict[tuple[str, str, str], object] = {}


def _once(fx: Fixtures, what: str, make):
    """Files written once per application and input folder."""
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir, what)
    if key not in _WRITTEN:
        _WRITTEN[key] = make()
    return _WRITTEN[key]


DOC_FILES = """
files as (
  select source as project, concat(lang, '/', case doc_id % 4 when 0 then '_' when 1 then '.' else '' end,
         cast(doc_id as string), case doc_id % 3 when 0 then '.mov' else '' end) as rel_path, text
  from documents)"""


def _archive(fx: Fixtures) -> str:
    """Every document as a file below ``<source>/<lang>``; gives the archive's root.

    Half of the names start with ``_`` or ``.``, which Spark's own file sources skip.
    """

    def write() -> str:
        root = new_folder(fx.spark, "archive")
        fx.table("documents").createOrReplaceTempView("documents")
        rows = fx.spark.sql(
            f"with {DOC_FILES} select concat(project, '/', rel_path) as path,"
            " encode(text, 'UTF-8') as content from files"
        )
        wanted = rows.count()
        written = export.write_contents(rows, root).count()
        assert written == wanted, f"{written} of {wanted} files written"
        return root

    return _once(fx, "archive", write)


def _inventory(fx: Fixtures) -> DataFrame:
    listing = inventory.read_inventory(fx.spark, _archive(fx), depth=0)
    inside = discovery.with_project(listing, depth=0)
    return discovery.regular_files(inside)


@query(
    (),
    "select project, rel_path, cast(strlen(text) as bigint) as size from files",
    ctes=DOC_FILES,
)
def read_inventory(fx: Fixtures) -> DataFrame:
    return _inventory(fx).select("project", "rel_path", "size")


@query(
    (),
    """select project, rel_path, 'md5' as fmt, md5(text) as digest, 'ok' as status from files
       union all
       select project, rel_path, 'sha1', sha1(text), 'ok' from files""",
    ctes=DOC_FILES,
)
def compute_digests(fx: Fixtures) -> DataFrame:
    out = digests.compute_digests(
        _inventory(fx).select("project", "rel_path", "size", "mtime_ns"),
        _archive(fx),
        formats=["md5", "sha1"],
    )
    return out.select("project", "rel_path", "fmt", "digest", "status")


# --- manifests: one full generation per project, written and read back -------------------------


def _manifest_name() -> Column:
    return F.concat(F.lit("0001_"), "project", F.lit("_1998-06-01_120000Z.mhl")).alias("manifest")


def _exported(fx: Fixtures) -> tuple[str, DataFrame]:
    """Export every project's first generation, its chain and the archive's references."""

    def write() -> tuple[str, DataFrame]:
        root = new_folder(fx.spark, "manifests")
        current = fx["fx_current"]
        files = current.select(
            "project",
            _manifest_name(),
            "rel_path",
            "size",
            "mtime_ns",
            F.lit("md5").alias("fmt"),
            "digest",
            F.lit("original").alias("action"),
        )
        folders = rollup.directory_hashes(
            current.select("project", "rel_path", "digest"), "md5"
        ).select("project", _manifest_name(), "rel_path", F.lit("md5").alias("fmt"), "content",
                 "structure")
        heads = current.select("project").distinct().select(
            "project",
            _manifest_name(),
            now().alias("created_at"),
            F.lit("host & co").alias("hostname"),
            F.lit("keepsake").alias("tool"),
            F.lit("1").alias("tool_version"),
            F.array(*map(F.lit, ("._*", "<*>.tmp", "ascmhl/"))).alias("patterns"),
        )
        lines = export.manifest_lines(heads, files, folders)
        written = export.write_lines(lines, root)
        path = new_folder(fx.spark, "written")
        written.write.parquet(path)
        written = fx.spark.read.parquet(path)
        chain = written.select(
            F.regexp_extract("path", "^([^/]+)/", 1).alias("project"),
            F.lit(1).alias("generation_no"),
            basename(F.col("path")).alias("manifest"),
            "c4",
        )
        export.write_lines(export.chain_lines(chain), root).count()
        return root, written

    return _once(fx, "manifests", write)


@query(
    ("fx_current",),
    """select distinct project || '/ascmhl/0001_' || project || '_1998-06-01_120000Z.mhl' as path,
              90 as c4_length, true as has_bytes from fx_current""",
)
def export_manifests(fx: Fixtures) -> DataFrame:
    _, written = _exported(fx)
    return written.select(
        "path", F.length("c4").alias("c4_length"), (F.col("bytes") > 0).alias("has_bytes")
    )


@query(
    ("fx_current",),
    """select project, 1 as generation_no, rel_path, size, 'md5' as fmt, digest, 'original' as action,
              strftime(make_timestamp(cast(mtime_ns // 1000 as bigint)), '%Y-%m-%dT%H:%M:%S.%fZ')
                as modified_at
       from fx_current""",
)
def read_manifests(fx: Fixtures) -> DataFrame:
    root, _ = _exported(fx)
    return manifests.read_generation_files(fx.spark, root).select(
        basename(F.col("folder")).alias("project"), "generation_no", "rel_path", "size", "fmt",
        "digest", "action", "modified_at",
    )


def _histories(fx: Fixtures) -> DataFrame:
    """The exported history files, found by the inventory and parsed once."""

    def parse() -> DataFrame:
        root, _ = _exported(fx)
        listing = inventory.read_inventory(fx.spark, root, depth=0)
        found = histories.history_paths(listing)
        return stage_table(histories.read_histories(found, root), "histories")

    return _once(fx, "histories", parse)


@query(
    ("fx_current",),
    """select project, 1 as generation_no, rel_path, size, 'md5' as fmt, digest, 'original' as action,
              strftime(make_timestamp(cast(mtime_ns // 1000 as bigint)), '%Y-%m-%dT%H:%M:%S.%fZ')
                as modified_at
       from fx_current""",
)
def read_histories(fx: Fixtures) -> DataFrame:
    """The files of every manifest, from the inventory's paths."""
    return histories.section(_histories(fx), "file").select(
        F.col("folder").alias("project"), "generation_no", "rel_path", "size", "fmt", "digest",
        "action", "modified_at",
    )


@query(("fx_current",), ROLLUP_SQL, ctes=ROLLUP)
def read_history_folders(fx: Fixtures) -> DataFrame:
    return histories.section(_histories(fx), "folder").select(
        F.col("folder").alias("project"), "rel_path", "content", "structure"
    )


@query(
    ("fx_current",),
    """select distinct project, 1 as generation_no,
              '0001_' || project || '_1998-06-01_120000Z.mhl' as manifest, 'ok' as status
       from fx_current""",
)
def chain_against_bytes(fx: Fixtures) -> DataFrame:
    """Every chain entry's C4 against the bytes of its manifest."""
    found = _histories(fx)
    key = ("folder",)
    out = generations.verify_chain(
        histories.section(found, "chain"), histories.section(found, "bytes"), key
    )
    return out.select(F.col("folder").alias("project"), "generation_no", "manifest", "status")


@query(("fx_current",), ROLLUP_SQL, ctes=ROLLUP)
def read_manifest_folders(fx: Fixtures) -> DataFrame:
    root, _ = _exported(fx)
    return manifests.read_generation_dirs(fx.spark, root).select(
        basename(F.col("folder")).alias("project"), "rel_path", "content", "structure"
    )


@query(
    ("fx_current",),
    """select distinct project, 1 as generation_no, timestamp '1998-06-01 12:00:00' as created_at,
              'host & co' as hostname, 'keepsake' as tool, '1' as tool_version, 'in-place' as process,
              '._*|<*>.tmp|ascmhl/' as patterns from fx_current""",
)
def read_generations(fx: Fixtures) -> DataFrame:
    root, _ = _exported(fx)
    out = manifests.read_generations(fx.spark, root)
    return out.select(
        basename(F.col("folder")).alias("project"), "generation_no", "created_at", "hostname",
        "tool", "tool_version", "process", F.array_join("patterns", "|").alias("patterns"),
    )


@query(
    ("fx_current",),
    """select distinct project, 1 as generation_no,
              '0001_' || project || '_1998-06-01_120000Z.mhl' as manifest, 90 as c4_length
       from fx_current""",
)
def read_chain(fx: Fixtures) -> DataFrame:
    root, _ = _exported(fx)
    return manifests.read_chain(fx.spark, root).select(
        basename(F.col("folder")).alias("project"), "generation_no", "manifest",
        F.length("c4").alias("c4_length"),
    )


@query(
    ("fx_current",),
    """select project, n as generation_no, case when n = 2 then 'missing'
              when cast(substr(project, 4) as int) % 3 = 0 then 'mismatch' else 'ok' end as status
       from (select distinct project from fx_current) p, (select unnest([1, 2]) as n) g
       where n = 1 or cast(substr(project, 4) as int) % 4 = 0""",
)
def verify_chain(fx: Fixtures) -> DataFrame:
    """Some chains name other bytes, some a manifest that is not there."""
    root, _ = _exported(fx)
    number = F.expr("substring(project, 4)").cast("int")
    chain = manifests.read_chain(fx.spark, root).select(
        basename(F.col("folder")).alias("project"), "generation_no", "manifest", "c4"
    )
    chain = chain.withColumn(
        "c4", F.when(number % 3 == 0, F.reverse("c4")).otherwise(F.col("c4"))
    )
    lost = chain.where(number % 4 == 0).withColumns(
        {"generation_no": F.lit(2), "manifest": F.replace("manifest", F.lit("0001"), F.lit("0002"))}
    )
    listing = inventory.read_inventory(fx.spark, root, depth=0)
    on_disk = discovery.with_project(listing, depth=0).where(F.col("rel_path").endswith(".mhl"))
    found = digests.compute_digests(
        on_disk.select("project", "rel_path", "size", "mtime_ns"), root, formats=["c4"],
        allowed=("c4",),
    ).select("project", basename(F.col("rel_path")).alias("manifest"), F.col("digest").alias("actual"))
    out = generations.verify_chain(chain.unionByName(lost), found)
    return out.select("project", "generation_no", "status")


@query(
    ARCHIVE,
    "select rel_path, manifest as path, c4 from referenced",
    ctes=REFERENCED,
)
def read_references(fx: Fixtures) -> DataFrame:
    """The references-only manifest of the archive root, written and read back."""

    def write() -> str:
        root = new_folder(fx.spark, "root")
        name = F.lit("0001_root_1998-06-01_120000Z.mhl").alias("manifest")
        references = _referenced(fx).select(
            F.lit("root").alias("project"), name, F.col("manifest").alias("path"), "c4"
        )
        head = references.select("project", "manifest").distinct().select(
            "*",
            now().alias("created_at"),
            F.lit("host").alias("hostname"),
            F.lit("keepsake").alias("tool"),
            F.lit("1").alias("tool_version"),
            F.array().cast("array<string>").alias("patterns"),
        )
        export.write_lines(export.manifest_lines(head, references=references), root).count()
        return root

    found = manifests.read_references(fx.spark, _once(fx, "references", write))
    return found.select(
        F.regexp_extract("path", "^(.*)/ascmhl/[^/]+$", 1).alias("rel_path"), "path", "c4"
    )


@query(
    ("fx_legacy",),
    """select project, manifest, '.' || chr(92) || split_part(rel_path, '/', -1) as name, tag, value,
              doc_id as size
       from fx_legacy""",
)
def read_origin_manifests(fx: Fixtures) -> DataFrame:
    """Origin manifests of the 1.x format, written and read back."""

    def write() -> str:
        root = new_folder(fx.spark, "origin")
        path = F.concat_ws("/", "project", "manifest").alias("path")
        rows = fx["fx_legacy"]
        name = F.concat(F.lit(".\\"), basename(F.col("rel_path")))
        entry = F.concat(
            F.lit("<hash><file>"), export.xml_text(name), F.lit("</file><size>"),
            F.col("doc_id").cast("string"), F.lit("</size><"), "tag", F.lit(">"), "value",
            F.lit("</"), "tag", F.lit("></hash>\n"),
        )
        whole = rows.select(path).distinct()
        lines = (
            rows.select(path, F.lit(1).alias("section"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
                        .alias("key"), entry.alias("line"))
            .unionByName(whole.select("path", F.lit(0).alias("section"), F.lit("").alias("key"),
                                      F.lit('<hashlist version="1.1">\n').alias("line")))
            .unionByName(whole.select("path", F.lit(2).alias("section"), F.lit("").alias("key"),
                                      F.lit("</hashlist>\n").alias("line")))
        )
        export.write_lines(lines, root).count()
        return root

    root = _once(fx, "origin", write)
    listing = inventory.read_inventory(fx.spark, root, depth=0)
    files = discovery.regular_files(discovery.with_project(listing, depth=0))
    out = manifests.read_origin_manifests(files, root)
    return out.select("project", "manifest", "name", "tag", "value", "size")


# --- tables ----------------------------------------------------------------------------------


@query(
    ("fx_projects",),
    "select id, rel_path, state from fx_projects where state in ('sealed', 'changed')",
)
def read_tables(fx: Fixtures) -> DataFrame:
    out = tables.read_rows(fx["fx_projects"], state=["sealed", "changed"])
    return out.select("id", "rel_path", "state")


@query(
    ("fx_current", "fx_previous", "fx_sealed"),
    """select project, rel_path, size from fx_current where cast(substr(project, 4) as int) < 12
       union all
       select project, rel_path, size from fx_previous where cast(substr(project, 4) as int) >= 12""",
)
def replace_per_key(fx: Fixtures) -> DataFrame:
    """Some projects' partitions are replaced, the others stay."""
    path = new_folder(fx.spark, "inventory")
    columns = ("project", "rel_path", "size")
    tables.replace_rows(fx["fx_current"].select(*columns), path, ["project"])
    later = fx["fx_previous"].where("cast(substr(project, 4) as int) >= 12").select(*columns)
    tables.replace_rows(later, path, ["project"])
    return fx.spark.read.schema("rel_path string, size bigint, project string").parquet(path)


@query(
    ("fx_projects",),
    """select id, case when id % 3 = 0 then 'changed' else state end as state, name, file_count
       from fx_projects where id % 2 = 1 or id % 3 = 0""",
)
def upsert(fx: Fixtures) -> DataFrame:
    """Two published snapshots; readers follow the pointer to the second."""
    projects = fx["fx_projects"].select("id", "state", "name", "file_count")
    store = tables.TableSet(fx.spark, new_folder(fx.spark, "state"))
    store.publish({"projects": tables.require_states(projects.where("id % 2 = 1"))})
    new = projects.where("id % 3 = 0").withColumn("state", F.lit("changed"))
    merged = tables.upsert(store.read("projects"), new, ["id"])
    store.publish({"projects": tables.require_states(merged)})
    return store.read("projects")


@query(
    ("fx_jobs",),
    """select id, kind, case when state = 'running' then 'done' else state end as state
       from fx_jobs""",
)
def append_latest(fx: Fixtures) -> DataFrame:
    """Outcomes are appended to the log; the last row of an item counts."""
    path = new_folder(fx.spark, "work")
    rows = fx["fx_jobs"].select("id", "kind", "state").withColumn("seq", F.lit(1))
    tables.append_rows(tables.require_work(rows), path)
    over = rows.where("state = 'running'").withColumns({"state": F.lit("done"), "seq": F.lit(2)})
    tables.append_rows(tables.require_work(over), path)
    log = fx.spark.read.schema(rows.schema).parquet(path)
    return tables.latest_rows(log, ["id"], ["seq"]).select("id", "kind", "state")


@query(
    ("fx_current", "fx_sealed"),
    """select 'sealed' as what, count(*) as n from fx_current
       union all select 'entries', count(*) from fx_current where size % 2 = 0""",
)
def publish_all(fx: Fixtures) -> DataFrame:
    """Tables of one generation become visible together."""
    store = tables.TableSet(fx.spark, new_folder(fx.spark, "generation"))
    store.publish({"sealed": fx["fx_sealed"], "entries": fx["fx_sealed"]}, ["project"])
    current = fx["fx_current"]
    store.publish({"sealed": current, "entries": current.where("size % 2 = 0")}, ["project"])
    parts = [
        store.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        for name in ("sealed", "entries")
    ]
    return parts[0].unionByName(parts[1])
