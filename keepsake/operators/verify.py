"""Fixity verification: what was read now against what was recorded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.config import MTIME_TOLERANCE_NS, VERIFICATION_PREFIX, VERIFY_PROBLEMS
from keepsake.functions.text import counted, joined, path_lists

BY = ("project",)


def compare_for_verify(
    sealed: DataFrame,
    current: DataFrame,
    by: Sequence[str] = BY,
    tolerance_ns: int = MTIME_TOLERANCE_NS,
) -> DataFrame:
    """``status`` per path of either side; both sides have ``size, mtime_ns, digest``.

    Different bytes under the same size and mtime are ``corrupt``: nobody wrote the file. A file
    that is there but gave no digest is ``unread``, which says nothing about its bytes.
    """
    old = sealed.select(
        *by,
        "rel_path",
        F.col("size").alias("old_size"),
        F.col("mtime_ns").alias("old_mtime_ns"),
        F.col("digest").alias("expected"),
    )
    new = current.select(
        *by,
        "rel_path",
        F.col("size").alias("new_size"),
        F.col("mtime_ns").alias("new_mtime_ns"),
        F.col("digest").alias("actual"),
    )
    same_stat = (F.col("old_size") == F.col("new_size")) & (
        F.abs(F.col("old_mtime_ns") - F.col("new_mtime_ns")) <= tolerance_ns
    )
    status = (
        F.when(F.col("new_mtime_ns").isNull(), "missing")
        .when(F.col("old_mtime_ns").isNull(), "added")
        .when(F.col("actual").isNull(), "unread")
        .when(F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("actual")), "ok")
        .when(same_stat, "corrupt")
        .otherwise("modified")
    )
    return old.join(new, [*by, "rel_path"], "full_outer").withColumn("status", status)


def problems(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin(*VERIFY_PROBLEMS))


def verify_reason(results: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``review_reason`` per project with a problem."""
    bad = problems(results)
    lists = path_lists(bad, by, **{s: F.count_if(F.col("status") == s) for s in VERIFY_PROBLEMS})
    heads = joined([counted(F.col(s), s) for s in VERIFY_PROBLEMS], ", ")
    text = F.concat(F.lit(f"{VERIFICATION_PREFIX} "), heads, F.lit("; files: "), F.col("listed"))
    return lists.select(*by, text.alias("review_reason"))


def verify_counts(results: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("files"))


def verify_review_items(results: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Review rows of the problem files."""
    return problems(results).select(
        *by,
        "rel_path",
        F.when(F.col("status") == "missing", "deleted").otherwise("modified").alias("change"),
        "old_size",
        "new_size",
        "old_mtime_ns",
        "new_mtime_ns",
    )


def verify_outcome(results: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per project: the resulting state, whether a full generation follows, and the counts.

    A clean verification stamps ``last_verified_at`` only; a problem writes nothing. With an unread
    file the project is in error, whatever the others are.
    """
    counts = results.groupBy(*by).agg(
        F.count_if(F.col("status").isin(*VERIFY_PROBLEMS)).alias("problems"),
        F.count_if(F.col("status") == "ok").alias("verified"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "unread").alias("__unread"),
    )
    whole = F.col("__unread") == 0
    clean = whole & (F.col("problems") == 0)
    return counts.withColumns(
        {
            "state": F.when(~whole, "error").when(clean, "sealed").otherwise("needs_review"),
            "writes_generation": clean,
            "stamps_verified": clean,
        }
    ).drop("__unread")


def verify_eligible(projects: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested projects (``id``) with ``skipped``: null, or the log line that says why."""
    can = F.col("last_generation_no").isNotNull() & F.col("state").isin(
        "sealed", "queued", "hashing"
    )
    reason = F.when(~can, F.concat(F.lit("verify skipped: project is "), F.col("state")))
    return requested.select("id").join(projects, "id").withColumn("skipped", reason)


def verify_report(results: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each project's latest run: a row per problem or added file, and one with the good ones.

    ``results`` has ``run``. Counts per run are combined before they are shuffled and only rows
    worth showing meet the latest run, so no project's files are gathered in one task.
    """
    counts = results.groupBy(*by, "run").agg(F.count_if(F.col("status") == "ok").alias("files"))
    latest = counts.groupBy(*by).agg(F.max(F.struct("run", "files")).alias("last"))
    latest = latest.select(*by, "last.run", "last.files")
    rank = (
        F.when(F.col("status") == "corrupt", 0)
        .when(F.col("status") == "modified", 1)
        .when(F.col("status") == "missing", 2)
        .otherwise(3)
    )
    shown = (
        results.where(F.col("status") != "ok")
        .join(latest.select(*by, "run"), [*by, "run"], "left_semi")
        .select(
            *by, "run", "status", rank.alias("rank"), "rel_path", F.lit(1).cast("bigint")
            .alias("files"),
        )
    )
    good = latest.select(
        *by,
        "run",
        F.lit("ok").alias("status"),
        F.lit(4).alias("rank"),
        F.lit(None).cast("string").alias("rel_path"),
        "files",
    )
    return shown.unionByName(good).orderBy(*by, "rank", "rel_path")
