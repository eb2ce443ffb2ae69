"""Manifest and chain XML as tables, through Spark's XML source with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.config import CHAIN_FILE, HISTORY_DIR, MANIFEST_FORMATS
from keepsake.sources.storage import open_read

_HASH = "struct<_VALUE: string, _action: string, _hashdate: string>"
_HASHES = ", ".join(f"{fmt}: {_HASH}" for fmt in MANIFEST_FORMATS)
_PATH = "struct<_VALUE: string, _size: bigint, _lastmodificationdate: string>"
FILE_SCHEMA = f"path {_PATH}, {_HASHES.replace(': struct', ' struct')}, previousPath string"
FOLDER_SCHEMA = f"path {_PATH}, content struct<{_HASHES}>, structure struct<{_HASHES}>"
CREATOR_SCHEMA = (
    "creationdate string, hostname string, tool struct<_VALUE: string, _version: string>"
)
PROCESS_SCHEMA = (
    f"process string, roothash struct<content: struct<{_HASHES}>, structure: struct<{_HASHES}>>,"
    " ignore struct<pattern: array<string>>"
)
REFERENCE_SCHEMA = "path string, c4 string"
CHAIN_SCHEMA = f"_sequencenr int, path string, c4 {_HASH}"


def _load(spark: SparkSession, path: str, row_tag: str, schema: str, files: str) -> DataFrame:
    """Elements named ``row_tag`` of every history file below ``path``, with where they stand."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", files)
        .schema(schema)
        .load(path)
    )
    # File URIs are percent-encoded; a plus sign in them is itself.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    here = raw.select("*", uri.alias("__uri"))
    where = F.regexp_extract("__uri", f"^(.*)/{HISTORY_DIR}/[^/]+$", 1)
    kept = here.where(F.col("__uri").rlike(f"/{HISTORY_DIR}/[^/]+$"))
    return kept.select(
        where.alias("folder"), F.element_at(F.split("__uri", "/"), -1).alias("manifest"), *raw.columns
    )


def _number() -> Column:
    return F.regexp_extract("manifest", "^([0-9]+)_", 1).try_cast("int").alias("generation_no")


def _long(struct: str | None) -> Column:
    """The format columns as an array of ``(fmt, digest, action)``, absent ones dropped."""
    prefix = f"{struct}." if struct else ""
    return F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(fmt).alias("fmt"),
                    F.col(f"{prefix}{fmt}._VALUE").alias("digest"),
                    F.col(f"{prefix}{fmt}._action").alias("action"),
                )
                for fmt in MANIFEST_FORMATS
            ]
        ),
        lambda h: h["digest"].isNotNull(),
    )


def read_generation_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``(manifest, file, fmt)``; ``folder`` is the folder the history describes."""
    rows = _load(spark, path, "hash", FILE_SCHEMA, "*.mhl")
    return rows.select(
        "folder",
        "manifest",
        _number(),
        F.col("path._VALUE").alias("rel_path"),
        F.col("path._size").alias("size"),
        F.col("path._lastmodificationdate").alias("modified_at"),
        F.explode(_long(None)).alias("hash"),
    ).select("folder", "manifest", "generation_no", "rel_path", "size", "modified_at", "hash.*")


def _folder_hashes(rows: DataFrame, rel_path: Column) -> DataFrame:
    structure = F.map_from_entries(
        F.transform(_long("structure"), lambda h: F.struct(h["fmt"], h["digest"]))
    )
    return rows.select(
        "folder",
        "manifest",
        _number(),
        rel_path.alias("rel_path"),
        F.explode(_long("content")).alias("hash"),
        structure.alias("structures"),
    ).select(
        "folder",
        "manifest",
        "generation_no",
        "rel_path",
        "hash.fmt",
        F.col("hash.digest").alias("content"),
        F.try_element_at("structures", F.col("hash.fmt")).alias("structure"),
    )


def read_generation_dirs(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``(manifest, folder, fmt)`` with ``content`` and ``structure``; root is ``""``."""
    folders = _load(spark, path, "directoryhash", FOLDER_SCHEMA, "*.mhl")
    roots = _load(spark, path, "processinfo", PROCESS_SCHEMA, "*.mhl").where("roothash is not null")
    return _folder_hashes(folders, F.col("path._VALUE")).unionByName(
        _folder_hashes(roots.select("folder", "manifest", "roothash.*"), F.lit(""))
    )


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest: when, where and with what it was written, and its patterns."""
    creator = _load(spark, path, "creatorinfo", CREATOR_SCHEMA, "*.mhl").select(
        "folder",
        "manifest",
        _number(),
        F.try_to_timestamp(F.col("creationdate")).alias("created_at"),
        "hostname",
        F.col("tool._VALUE").alias("tool"),
        F.col("tool._version").alias("tool_version"),
    )
    process = _load(spark, path, "processinfo", PROCESS_SCHEMA, "*.mhl").select(
        "folder", "manifest", "process", F.col("ignore.pattern").alias("patterns")
    )
    return creator.join(process, ["folder", "manifest"])


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """References of one manifest to others, by path and C4."""
    rows = _load(spark, path, "hashlistreference", REFERENCE_SCHEMA, "*.mhl")
    return rows.select("folder", "manifest", _number(), "path", "c4")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Chain entries: generation number, manifest name and C4."""
    rows = _load(spark, path, "hashlist", CHAIN_SCHEMA, CHAIN_FILE)
    return rows.select(
        "folder",
        F.col("_sequencenr").alias("generation_no"),
        F.col("path").alias("manifest"),
        F.col("c4._VALUE").alias("c4"),
    )


# --- origin manifests (format 1.x) -----------------------------------------------------------

ORIGIN_VERSIONS = ("1.0", "1.1")
ORIGIN_SKIPPED = ("file", "size", "lastmodificationdate", "hashdate", "directory")
ORIGIN_SCHEMA = (
    "manifest string, position bigint, name string, size bigint, tag string, value string,"
    " warning string"
)


def origin_candidates(files: DataFrame) -> DataFrame:
    """``*.mhl`` files of a project outside every history folder."""
    path = F.col("rel_path")
    return files.where(
        F.lower(path).endswith(".mhl") & ~path.rlike(f"(^|/){HISTORY_DIR}/")
    )


def origin_entries(path: str) -> Iterator[tuple]:
    """``(position, name, size, tag, value, warning)`` of one file, streamed.

    Nothing for a file that is no readable 1.x hash list; one warning if it breaks off inside.
    """
    position, short = 0, path.rsplit("/", 1)[-1]
    accepted = False
    try:
        with open_read(path) as source:
            events = ElementTree.iterparse(source, events=("start", "end"))
            _, top = next(events)
            if top.tag != "hashlist" or top.get("version") not in ORIGIN_VERSIONS:
                return
            accepted = True
            level = 1
            for event, node in events:
                level += 1 if event == "start" else -1
                if event == "start" or level != 1:
                    continue
                if node.tag == "hash":
                    name = (node.findtext("file") or "").strip()
                    size = (node.findtext("size") or "").strip()
                    length = int(size) if size.isdigit() else None
                    if not name:
                        yield position, None, None, None, None, f"{short}: <hash> without <file>"
                        position += 1
                    else:
                        for child in node:
                            if child.tag not in ORIGIN_SKIPPED:
                                yield position, name, length, child.tag, child.text or "", None
                                position += 1
                top.clear()
    except (ElementTree.ParseError, StopIteration, OSError) as exc:
        if accepted:
            yield position, None, None, None, None, f"{short}: unreadable ({exc})"


def read_origin_manifests(
    files: DataFrame, root: str, by: Sequence[str] = ("project",)
) -> DataFrame:
    """Entries and warnings of the origin manifests among ``files`` below ``root``."""
    keys = list(by)
    schema = ", ".join(f"`{k}` string" for k in keys) + ", " + ORIGIN_SCHEMA
    columns = [*keys, "manifest", "position", "name", "size", "tag", "value", "warning"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                head = [row[k] for k in keys]
                path = f"{root}/{row[keys[-1]]}/{row['rel_path']}"
                out = []
                for entry in origin_entries(path):
                    out.append([*head, row["rel_path"], *entry])
                    if len(out) >= 10_000:
                        yield frame(out)
                        out = []
                if out:
                    yield frame(out)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    picked = origin_candidates(files).select(*keys, "rel_path")
    return picked.repartition(*[F.col(c) for c in (*keys, "rel_path")]).mapInPandas(read, schema)
