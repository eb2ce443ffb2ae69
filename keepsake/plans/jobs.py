"""Seal, append, accept and verify for many projects at once.

Each takes tables and gives tables: the entries of the new generations, the rows that replace the
sealed ones, what goes to review, and one outcome per project. Projects that must not be written
are split off by an anti-join before anything is recorded for them. What several results of a job
need (its problems, its new entries) is staged once instead of being computed for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import ORIGIN_FORMATS, PRIMARY_FORMAT
from keepsake.functions.text import path_lists
from keepsake.operators import diff, generations, origin, verify
from keepsake.session import stage_table

BY = ("project",)


@dataclass(frozen=True)
class Result:
    entries: DataFrame  # (project, rel_path, fmt, digest, action)
    sealed: DataFrame  # (project, rel_path, size, mtime_ns, digest)
    review_items: DataFrame
    outcome: DataFrame  # (project, state, review_reason, writes_generation, files, bytes)


def _once(df: DataFrame) -> DataFrame:
    """Written as a table, so that what several results need is computed once."""
    return stage_table(df, "job")


def _good(digests: DataFrame) -> DataFrame:
    """Digests of files that were read whole; the reader's ``status``, if given, says which."""
    good = F.col("digest").isNotNull()
    if "status" in digests.columns:
        good = good & (F.col("status") == "ok")
    return digests.where(good)


def _unread(files: DataFrame, good: DataFrame, by: Sequence[str]) -> DataFrame:
    """Projects with a file that has no digest: their job has failed and records nothing."""
    lacking = files.join(good.select(*by, "rel_path").distinct(), [*by, "rel_path"], "left_anti")
    text = F.concat(F.col("n_paths").cast("string"), F.lit(" files without a digest: "), "listed")
    return path_lists(lacking, by).select(
        *by, text.alias("review_reason"), F.lit("error").alias("blocked")
    )


def _whole(
    files: DataFrame, digests: DataFrame, primary: str, by: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files and digests of the projects that were read whole, and why the others were not.

    The reader's rows are taken once, however many results are derived from them; digests of paths
    that are no present file are left out.
    """
    read = _once(digests)
    good = _good(read)
    unread = _once(_unread(files, good.where(F.col("fmt") == primary), by))
    present = files.join(unread.select(*by), list(by), "left_anti")
    kept = good.join(present.select(*by, "rel_path").distinct(), [*by, "rel_path"], "left_semi")
    return present, kept.select(*by, "rel_path", "fmt", "digest"), unread


def _inherited(expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """The origin formats of each project (three at most)."""
    kinds = expected.where(F.col("fmt").isin(*ORIGIN_FORMATS))
    return kinds.groupBy(*by).agg(F.collect_set("fmt").alias("inherited"))


def _with_inherited(digests: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = digests.join(_inherited(expected, by), list(by), "left")
    return rows.withColumn("inherited", F.coalesce("inherited", none))


def _origin_reasons(problems: DataFrame, by: Sequence[str]) -> DataFrame:
    text = F.concat(
        F.col("n_paths").cast("string"),
        F.lit(" files do not match their legacy MHL 1.x: "),
        F.col("listed"),
    )
    return _review(path_lists(problems, by).select(*by, text.alias("review_reason")))


# What a history can have against a new generation, the first one found decides.
_OBJECTIONS = (
    ("missing", "needs_review", "files recorded in the history are missing: "),
    ("hash mismatch", "needs_review", "hash mismatch (review, not a generation): "),
    ("none of the recorded formats was given", "error", "none of the recorded formats was given: "),
    ("at least one format must be original", "error", "at least one format must be original: "),
)


def _history_reasons(bad: DataFrame, by: Sequence[str]) -> DataFrame:
    """Why a project's history stops a generation, and the state that leads to.

    ``bad`` has ``rel_path`` and ``problem``.
    """
    problem = F.col("problem")
    rank, state, text = (F.lit(None).cast(t) for t in ("int", "string", "string"))
    for n, (name, leads_to, head) in enumerate(_OBJECTIONS):
        rank = F.when(problem == name, n).otherwise(rank)
        state = F.when(F.col("rank") == n, leads_to).otherwise(state)
        text = F.when(F.col("rank") == n, head).otherwise(text)
    ranked = bad.select(*by, "rel_path", rank.alias("rank")).distinct()
    first = ranked.groupBy(*by).agg(F.min("rank").alias("rank"))
    lists = path_lists(ranked.join(first, [*by, "rank"], "left_semi"), [*by, "rank"])
    return lists.select(
        *by, F.concat(text, "listed").alias("review_reason"), state.alias("blocked")
    )


def _outcome(files: DataFrame, reasons: DataFrame, by: Sequence[str], **extra: Column) -> DataFrame:
    totals = files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes")
    )
    return totals.join(reasons, list(by), "left").select(
        *by,
        F.coalesce("blocked", F.lit("sealed")).alias("state"),
        "review_reason",
        F.col("blocked").isNull().alias("writes_generation"),
        "files",
        "bytes",
        *[c.alias(n) for n, c in extra.items()],
    )


def _review(reasons: DataFrame) -> DataFrame:
    return reasons.withColumn("blocked", F.lit("needs_review"))


def _sealed_rows(files: DataFrame, digests: DataFrame, primary: str, by: Sequence[str]) -> DataFrame:
    own = digests.where(F.col("fmt") == primary).select(*by, "rel_path", "digest")
    return files.select(*by, "rel_path", "size", "mtime_ns").join(own, [*by, "rel_path"])


def seal(
    files: DataFrame,
    digests: DataFrame,
    expected: DataFrame,
    history: DataFrame,
    primary: str = PRIMARY_FORMAT,
    by: Sequence[str] = BY,
) -> Result:
    """A full generation of every project whose files match their origin and their history.

    ``files`` are the present files, ``digests`` ``(project, rel_path, fmt, digest)`` of them,
    ``expected`` the merged origin digests, ``history`` earlier entries with ``generation_no``.
    A project with a file whose primary digest is absent, null or not ``ok`` ends in ``error``.
    """
    all_files = files
    files, digests, unread = _whole(files, digests, primary, by)
    problems = _once(origin.origin_problems(expected, files, digests, by=by))
    origin_reasons = _once(_origin_reasons(problems, by))
    clean = digests.join(origin_reasons.select(*by), list(by), "left_anti")
    actions = _once(
        generations.assign_actions(
            _with_inherited(clean, expected, by), history, F.col("inherited"), by
        ).drop("inherited")
    )
    clean_files = files.join(origin_reasons.select(*by), list(by), "left_anti")
    gone = (
        history.select(*by, "rel_path")
        .distinct()
        .join(clean_files.select(*by).distinct(), list(by), "left_semi")
        .join(files.select(*by, "rel_path"), [*by, "rel_path"], "left_anti")
    )
    gone = gone.withColumn("problem", F.lit("missing"))
    failed = actions.where(F.col("problem").isNotNull()).select(*by, "rel_path", "problem")
    history_reasons = _once(_history_reasons(failed.unionByName(gone), by))
    reasons = origin_reasons.unionByName(history_reasons).unionByName(unread)
    entries = actions.join(history_reasons.select(*by), list(by), "left_anti").drop("problem")
    written = clean_files.join(history_reasons.select(*by), list(by), "left_anti")
    return Result(
        entries,
        _sealed_rows(written, digests, primary, by),
        problems,
        _outcome(all_files, reasons, by),
    )


def append(
    files: DataFrame,
    sealed: DataFrame,
    digests: DataFrame,
    expected: DataFrame,
    history: DataFrame,
    primary: str = PRIMARY_FORMAT,
    by: Sequence[str] = BY,
) -> Result:
    """A partial generation with the added files; anything modified or deleted goes to review."""
    rows = _once(diff.diff_against_sealed(files, sealed, by).where("change <> 'unchanged'"))
    diff_reasons = _once(_review(diff.review_reason(rows, by)))
    added = (
        rows.where(F.col("change") == "added")
        .join(diff_reasons.select(*by), list(by), "left_anti")
        .select(*by, "rel_path", F.col("new_size").alias("size"),
                F.col("new_mtime_ns").alias("mtime_ns"))
    )
    added, digests, unread = _whole(added, digests, primary, by)
    scoped = origin.append_scope(expected, added.withColumn("change", F.lit("added")), by)
    new_digests = digests.join(added.select(*by, "rel_path"), [*by, "rel_path"], "left_semi")
    problems = _once(origin.origin_problems(scoped, added, new_digests, by=by))
    origin_reasons = _once(_origin_reasons(problems, by))
    kept = added.join(origin_reasons.select(*by), list(by), "left_anti")
    actions = _once(
        generations.partial_generation(
            _with_inherited(new_digests, scoped, by), kept, history, F.col("inherited"), by
        ).drop("inherited", "is_full")
    )
    history_reasons = _once(_history_reasons(actions.where(F.col("problem").isNotNull()), by))
    kept = kept.join(history_reasons.select(*by), list(by), "left_anti")
    entries = actions.join(history_reasons.select(*by), list(by), "left_anti").drop("problem")
    reasons = diff_reasons.unionByName(origin_reasons).unionByName(history_reasons)
    reasons = reasons.unionByName(unread)
    new_rows = _sealed_rows(kept, digests, primary, by)
    old_rows = sealed.select(*by, "rel_path", "size", "mtime_ns", "digest")
    # Counted before the project is a join key, so the count is combined before its shuffle.
    counts = (
        rows.where(F.col("change") == "added")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("__added"))
        .join(diff_reasons.select(*by), list(by), "left_anti")
    )
    outcome = _outcome(files, reasons, by).join(counts, list(by), "left")
    outcome = outcome.withColumn(
        "writes_generation", F.col("writes_generation") & F.col("__added").isNotNull()
    ).withColumn("added", F.coalesce("__added", F.lit(0))).drop("__added")
    items = diff.review_items(rows, by=by).unionByName(
        problems.select(
            *by,
            "rel_path",
            "change",
            F.lit(None).cast("bigint").alias("old_size"),
            "new_size",
            F.lit(None).cast("bigint").alias("old_mtime_ns"),
            "new_mtime_ns",
        )
    )
    return Result(entries, old_rows.unionByName(new_rows), items, outcome)


def accept_new_version(
    files: DataFrame,
    digests: DataFrame,
    expected: DataFrame,
    old_generations: DataFrame,
    stamp: Column,
    primary: str = PRIMARY_FORMAT,
    by: Sequence[str] = BY,
) -> tuple[Result, DataFrame]:
    """The folder as it is becomes generation 1 of a new history; the old one is set aside.

    Origin problems only cost the files concerned their origin formats. ``old_generations`` has
    ``epoch`` and ``superseded_at``; they come back with the accepted ones stamped, and the
    outcome says which epoch begins. A project that was not read whole ends in ``error`` and keeps
    its history; accepting clears the review, so no review items are left.
    """
    all_files = files
    files, digests, unread = _whole(files, digests, primary, by)
    problems = _once(origin.origin_problems(expected, files, digests, by=by))
    kept = origin.accept_overrides(digests, problems, by)
    nothing = digests.limit(0).withColumn("generation_no", F.lit(0))
    entries = generations.assign_actions(
        _with_inherited(kept, expected, by), nothing, F.col("inherited"), by
    ).drop("inherited", "problem")
    warnings = problems.groupBy(*by).agg(F.count(F.lit(1)).alias("overridden"))
    epochs = old_generations.groupBy(*by).agg(F.max("epoch").alias("epoch"))
    outcome = (
        _outcome(all_files, unread, by)
        .join(warnings, list(by), "left")
        .join(epochs, list(by), "left")
        .withColumns(
            {
                "overridden": F.coalesce("overridden", F.lit(0)),
                "epoch": F.coalesce("epoch", F.lit(0)) + F.col("writes_generation").cast("int"),
                "generation_no": F.when(F.col("writes_generation"), 1),
            }
        )
    )
    aside = generations.supersede_history(old_generations, files.select(*by), stamp, by)
    sealed = _sealed_rows(files, digests, primary, by)
    return Result(entries, sealed, problems.limit(0), outcome), aside


def verify_projects(
    sealed: DataFrame,
    current: DataFrame,
    history: DataFrame,
    fmt: str = PRIMARY_FORMAT,
    by: Sequence[str] = BY,
) -> tuple[Result, DataFrame]:
    """Compare a fresh read (``current`` with ``digest``) with the record.

    A clean project gets a full generation and ``last_verified_at``; a problem writes nothing. A
    project with a file that could not be read (null digest, or ``status`` not ok) is not judged:
    it ends in ``error``. Also gives the result row of every file.
    """
    current = _once(current)
    good = _good(current)
    unread = _once(_unread(current, good, by))
    read = good.select(*by, "rel_path", F.col("digest").alias("__read"))
    seen = current.join(read, [*by, "rel_path"], "left").withColumn("digest", F.col("__read"))
    results = _once(verify.compare_for_verify(sealed, seen, by))
    judged = results.join(unread.select(*by), list(by), "left_anti")
    reasons = _once(_review(verify.verify_reason(judged, by)).unionByName(unread))
    clean = current.join(reasons.select(*by), list(by), "left_anti")
    given = clean.select(*by, "rel_path", F.lit(fmt).alias("fmt"), "digest")
    actions = _once(generations.assign_actions(given, history, (), by))
    disagreeing = _once(
        _history_reasons(actions.where(F.col("problem").isNotNull()), by).withColumn(
            "review_reason", F.concat(F.lit("verification: "), "review_reason")
        )
    )
    entries = actions.join(disagreeing.select(*by), list(by), "left_anti").drop("problem")
    written = clean.join(disagreeing.select(*by), list(by), "left_anti")
    stamps = F.col("review_reason").isNull()
    outcome = _outcome(
        current, reasons.unionByName(disagreeing), by, stamps_verified=stamps
    )
    rows = written.select(*by, "rel_path", "size", "mtime_ns", "digest")
    return Result(entries, rows, verify.verify_review_items(judged, by), outcome), results
