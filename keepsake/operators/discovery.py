"""Projects, strays and ignore filtering over an archive-relative listing ``(path, size, kind)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import (
    CHAIN_FILE,
    DEFAULT_PATTERNS,
    HISTORY_DIR,
    IGNORE_PREFIXES,
    SUPERSEDED_DIR,
)
from keepsake.functions.paths import ancestors, components, parent, starts_with_any
from keepsake.functions.patterns import escaped_prefixes, excluded, ignored
from keepsake.operators.running import number_rows


def _usable(parts: Column, prefixes: str) -> Column:
    """No component is reserved or starts with an ignore prefix."""
    return F.forall(
        parts,
        lambda p: ~starts_with_any(p, prefixes) & ~p.isin(HISTORY_DIR, SUPERSEDED_DIR),
    )


def _project_of(depth: int) -> Column:
    return F.array_join(F.slice(components(F.col("path")), 1, depth + 1), "/")


def with_project(
    listing: DataFrame, depth: int = 1, prefixes: str = IGNORE_PREFIXES
) -> DataFrame:
    """Entries inside a project, with ``project`` and the project-relative ``rel_path``."""
    if depth < 0:
        raise ValueError("project_depth must be >= 0")
    parts = components(F.col("path"))
    return (
        listing.where(F.size(parts) > depth + 1)
        .where(_usable(F.slice(parts, 1, depth + 1), prefixes))
        .withColumn("project", _project_of(depth))
        .withColumn("rel_path", F.array_join(F.slice(parts, depth + 2, F.size(parts)), "/"))
    )


def discover_projects(
    listing: DataFrame,
    depth: int = 1,
    prefixes: str = IGNORE_PREFIXES,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per project folder: ``rel_path, name, has_history``."""
    inside = with_project(listing, depth, prefixes)
    return (
        inside.groupBy(*by, F.col("project").alias("rel_path"))
        .agg(F.bool_or(F.col("rel_path").startswith(HISTORY_DIR + "/")).alias("has_history"))
        .select(*by, "rel_path", F.element_at(F.split("rel_path", "/"), -1).alias("name"),
                "has_history")
    )


def has_history(
    listing: DataFrame,
    depth: int = 1,
    prefixes: str = IGNORE_PREFIXES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Both tests per project: it owns a history folder, and it owns a chain in it."""
    return with_project(listing, depth, prefixes).groupBy(*by, "project").agg(
        F.bool_or(F.col("rel_path").startswith(HISTORY_DIR + "/")).alias("owns_folder"),
        F.bool_or(F.col("rel_path") == f"{HISTORY_DIR}/{CHAIN_FILE}").alias("owns_chain"),
    )


def stray_entries(
    listing: DataFrame, depth: int = 1, prefixes: str = IGNORE_PREFIXES
) -> DataFrame:
    """Entries that are not folders at the root or at a level above the projects' contents."""
    if depth < 0:
        raise ValueError("project_depth must be >= 0")
    parts = components(F.col("path"))
    above = (F.size(parts) <= depth + 1) & (F.col("kind") != "empty")
    return listing.where(above & _usable(parts, prefixes)).orderBy("path")


def empty_folders(
    listing: DataFrame,
    depth: int = 1,
    prefixes: str = IGNORE_PREFIXES,
    by: Sequence[str] = (),
) -> DataFrame:
    """``rel_path`` of the project folders that are listed with nothing in them."""
    parts = components(F.col("path"))
    here = (F.col("kind") == "empty") & (F.size(parts) == depth + 1) & _usable(parts, prefixes)
    return listing.where(here).select(*by, F.col("path").alias("rel_path")).distinct()


def regular_files(listing: DataFrame) -> DataFrame:
    """Symlinks and special files are never part of a project's files."""
    return listing.where(F.col("kind") == "file")


def apply_ignore_patterns(
    files: DataFrame, patterns: Sequence[str] = DEFAULT_PATTERNS
) -> DataFrame:
    return files.where(~ignored(F.col("rel_path"), patterns))


def apply_exclude_globs(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    return files.where(~excluded(F.col("rel_path"), globs))


def effective_patterns(
    latest: DataFrame,
    globs: Sequence[str] = (),
    defaults: Sequence[str] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Add ``patterns``: the latest generation's, then defaults, then globs, each once.

    ``latest`` has ``latest_patterns array<string>`` (null without a history).
    """
    fixed = [F.lit(p) for p in dict.fromkeys([*defaults, *globs])]
    none = F.array().cast("array<string>")
    return latest.withColumn(
        "patterns",
        F.array_distinct(F.concat(F.coalesce("latest_patterns", none), F.array(*fixed))),
    )


def removed_globs(old: Sequence[str], new: Sequence[str], projects: DataFrame) -> DataFrame:
    """Globs taken out of the settings once anything is sealed: they stay in sealed histories."""
    gone = F.array_except(
        F.array(*map(F.lit, old)).cast("array<string>"),
        F.array(*map(F.lit, new)).cast("array<string>"),
    )
    sealed = F.count_if(F.col("last_generation_no").isNotNull()) > 0
    return projects.agg(sealed.alias("any_sealed")).select(
        "any_sealed",
        F.when(F.col("any_sealed"), F.array_join(gone, ", ")).otherwise("").alias("kept_globs"),
    )


def root_patterns(
    referenced: DataFrame,
    globs: Sequence[str] = (),
    prefixes: str = IGNORE_PREFIXES,
    root_path: str = "/",
) -> DataFrame:
    """Patterns of the archive root ``(position, pattern)``, each at its first appearance.

    ``referenced`` has ``rel_path`` and ``patterns array<string>`` per referenced project.
    """
    fixed = list(dict.fromkeys([*DEFAULT_PATTERNS, *globs, *escaped_prefixes(prefixes, root_path)]))
    spark = referenced.sparkSession
    own = spark.createDataFrame(
        [("", n, p) for n, p in enumerate(fixed)], "rel_path string, n int, pattern string"
    )
    theirs = referenced.select("rel_path", F.posexplode("patterns").alias("n", "pattern"))
    first = (
        own.withColumn("origin", F.lit(0))
        .unionByName(theirs.withColumn("origin", F.lit(1)))
        .groupBy("pattern")
        .agg(F.min(F.struct("origin", "rel_path", "n")).alias("first"))
        .select("pattern", "first.*")
    )
    return number_rows(first, [], ["origin", "rel_path", "n"]).select("position", "pattern")


def project_contents(
    listing: DataFrame,
    depth: int = 1,
    prefixes: str = IGNORE_PREFIXES,
    patterns: Sequence[str] = DEFAULT_PATTERNS,
    globs: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Per project: files left after filtering, unreadable entries, and whether it is empty.

    An unreadable entry counts as content: an incomplete listing decides nothing. ``listing``
    may carry ``error``.
    """
    inside = with_project(listing, depth, prefixes)
    error = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    counted = (
        (F.col("kind") == "file")
        & ~ignored(F.col("rel_path"), patterns)
        & ~excluded(F.col("rel_path"), globs)
    )
    return (
        inside.groupBy(*by, "project")
        .agg(
            F.count_if(counted & error.isNull()).alias("files"),
            F.count_if(error.isNotNull()).alias("errors"),
        )
        .withColumn("is_empty", (F.col("files") == 0) & (F.col("errors") == 0))
    )


def drop_empty_projects(
    candidates: DataFrame, contents: DataFrame, known: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """A new or missing project without content is not there; a tracked one is left to its scan."""
    key = [*by, "rel_path"]
    tracked = known.where(F.col("state") != "missing").select(*key)
    empty = contents.where("is_empty").select(*by, F.col("project").alias("rel_path"))
    absent = empty.join(tracked, key, "left_anti")
    return candidates.join(absent, key, "left_anti")


def nested_histories(
    listing: DataFrame, depth: int = 1, prefixes: str = IGNORE_PREFIXES
) -> DataFrame:
    """``(project, nested)``: folders below a project that hold a history of their own."""
    inside = with_project(listing, depth, prefixes)
    marker = f"(^|/){HISTORY_DIR}/[^/]+$"
    folders = (
        inside.where(F.col("rel_path").rlike(marker))
        .select("project", parent(parent(F.col("rel_path"))).alias("nested"))
        .where(F.col("nested") != "")
    )
    return folders.distinct()


def ancestor_rows(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """One row per folder above ``path`` (bounded by its depth)."""
    return df.withColumn("ancestor", F.explode(ancestors(F.col(path))))
