"""Listing an archive with the cluster: one round of tasks per folder level."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.config import DEFAULT_PATTERNS, HISTORY_DIR, IGNORE_PREFIXES, SUPERSEDED_DIR
from keepsake.functions.patterns import ignore_rule
from keepsake.session import stage
from keepsake.sources.storage import entries

LISTING = "path string, kind string, size bigint, mtime_ns bigint, error string"


def _prunes(depth: int, prefixes: str, patterns: Sequence[str]) -> Callable[[str], bool]:
    """Whether a folder (archive-relative path) is not descended into."""
    rules = [
        (negated, re.compile(expression, re.DOTALL))
        for negated, _, expression in filter(None, map(ignore_rule, patterns))
    ]

    def prune(path: str) -> bool:
        parts = path.split("/")
        if len(parts) <= depth + 1:
            return parts[-1][:1] in tuple(prefixes) or parts[-1] in (HISTORY_DIR, SUPERSEDED_DIR)
        inside = "/".join(parts[depth + 1 :])
        if inside == HISTORY_DIR:
            return False  # its manifests are listed; the ignore filter keeps them out of the files
        verdict = False
        for negated, expression in rules:
            if expression.fullmatch(inside):
                verdict = not negated
        return verdict

    return prune


def read_inventory(
    spark: SparkSession,
    root: str,
    depth: int = 1,
    prefixes: str = IGNORE_PREFIXES,
    patterns: Sequence[str] = DEFAULT_PATTERNS,
    folders_per_task: int = 64,
) -> DataFrame:
    """Every entry below ``root`` as ``(path, kind, size, mtime_ns, error)``; nothing is read.

    Folders that the ignore prefixes or patterns drop are not descended into. Each round lists the
    folders the round before found, spread over new tasks, so a huge project does not stay with
    the task that met it first. A folder that cannot be listed is a row with ``error``, kind
    ``folder``; entries that cannot be read likewise. A project's folder, or one below it, that has
    no entry is a row of kind ``empty``: the project is there, with nothing in it.
    """
    prune = _prunes(depth, prefixes, patterns)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for folder in batch["path"]:
                entry = None
                try:
                    for entry in entries(f"{root}/{folder}"):
                        name, kind, size, mtime, error = entry
                        path = f"{folder}/{name}" if folder else name
                        if kind != "folder" or not prune(path):
                            out.append((path, kind, size, mtime, error))
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                except OSError as exc:
                    out.append((folder, "folder", 0, 0, exc.strerror or str(exc)))
                else:
                    if entry is None and folder and folder.count("/") >= depth:
                        out.append((folder, "empty", 0, 0, None))
        yield pd.DataFrame(out, columns=columns)

    columns = ["path", "kind", "size", "mtime_ns", "error"]
    found: list[DataFrame] = []
    todo, waiting = spark.createDataFrame([("",)], "path string"), 1
    at_least = 4 * spark.sparkContext.defaultParallelism
    while waiting:
        # Few folders may hold many files each: spread them over the cluster all the same.
        tasks = max(-(-waiting // folders_per_task), min(waiting, at_least))
        level = stage(todo.repartition(tasks, "path").mapInPandas(visit, LISTING))
        found.append(level.where((F.col("kind") != "folder") | F.col("error").isNotNull()))
        todo = level.where((F.col("kind") == "folder") & F.col("error").isNull()).select("path")
        waiting = todo.count()
    return reduce(DataFrame.unionByName, found)


def listing_errors(listing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Folders whose listing failed: nothing below them is known to be gone."""
    failed = (F.col("kind") == "folder") & F.col("error").isNotNull()
    return listing.where(failed).select(*by, "path")
