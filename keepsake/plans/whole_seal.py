"""From the bytes of an archive to published manifests, as one run that can die and go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.config import HISTORY_DIR, PRIMARY_FORMAT
from keepsake.functions.text import path_lists
from keepsake.operators import digests, generations, planning, rollup
from keepsake.plans import jobs
from keepsake.plans.journal import Journal
from keepsake.sources import export
from keepsake.sources.tables import TableSet, append_rows

BY = ("project",)
_ENTRIES = (
    "project string, generation_no int, rel_path string, size bigint, mtime_ns bigint, fmt string,"
    " digest string, action string"
)
_CHAIN = "project string, generation_no int, manifest string, bytes bigint, c4 string"
_EXPECTED = "project string, rel_path string, fmt string, digest string"


@dataclass(frozen=True)
class Maker:
    """Who writes the manifests."""

    hostname: str
    tool: str = "keepsake"
    tool_version: str = "1"
    patterns: tuple[str, ...] = ()


def _blocked(paths: DataFrame, message: str) -> DataFrame:
    """``(project, review_reason, blocked)`` of the projects that have one of these paths."""
    text = F.concat(F.col("n_paths").cast("string"), F.lit(message), F.col("listed"))
    return path_lists(paths.select(*BY, "rel_path"), BY).select(
        *BY, text.alias("review_reason"), F.lit("error").alias("blocked")
    )


def _read(
    spark: SparkSession, files: DataFrame, expected: DataFrame, root: str, stored_at: str,
    primary: str, bucket_bytes: int, wave_buckets: int,
) -> None:
    """Read every file that no stored digest stands for; each wave is kept as soon as it is read."""
    wanted = digests.wanted_formats(files, expected, BY, primary)
    digests.read_in_waves(
        wanted, _good(spark, stored_at), root, lambda wave: append_rows(wave, stored_at), BY,
        bucket_bytes, wave_buckets,
    )


def _stored(spark: SparkSession, stored_at: str) -> DataFrame | None:
    try:
        return spark.read.schema(
            "project string, rel_path string, size bigint, mtime_ns bigint, fmt string,"
            " digest string, status string, error string"
        ).parquet(stored_at)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def _good(spark: SparkSession, stored_at: str) -> DataFrame | None:
    """Stored digests, one row per path, stat and format however often a wave was repeated."""
    stored = _stored(spark, stored_at)
    if stored is None:
        return None
    key = [*BY, *digests.STAT_KEY, "fmt"]
    return stored.where(F.col("status") == "ok").groupBy(*key).agg(F.max("digest").alias("digest"))


def seal_archive(
    spark: SparkSession,
    root: str,
    list_files: Callable[[], DataFrame],
    store: TableSet,
    manifests: str,
    run: str,
    now: Column,
    maker: Maker,
    expected: DataFrame | None = None,
    primary: str = PRIMARY_FORMAT,
    bucket_bytes: int = digests.BUCKET_BYTES,
    wave_buckets: int = 1024,
) -> DataFrame:
    """A full generation of every project below ``root`` that is whole and agrees with its record.

    ``list_files`` lists the archive afresh as ``(project, rel_path, size, mtime_ns)``; it is asked
    before and after the bytes are read, and a project with a file whose stat changed in between
    ends in ``error``, as does one with an unreadable file. ``expected`` are origin digests. A
    project whose history disagrees goes to review. For every other project the entries, folder
    hashes, manifest and chain of the next generation are made, and everything is published
    together, once.

    ``run`` names the run: called again under the same name after it died, it goes on after the
    last finished step, and within the reading after the last wave. Manifests lie below
    ``manifests``; a repeated step replaces them. The store has, each growing by what a run adds:
    ``outcome`` (run, run_no, project, state, review_reason, writes_generation, files, bytes,
    generation_no, manifest), ``entries``, ``folders``, ``sealed``, ``chain`` and ``work``. Gives
    the run's rows of ``outcome``.
    """
    steps = Journal(spark, f"{store.path}/runs/{run}")
    begun = steps.step(
        "intent",
        lambda: spark.createDataFrame([(run, store.last_number() + 1)], "run string, run_no bigint")
        .withColumn("started_at", now),
    ).first()
    run_no, started_at = begun["run_no"], F.lit(begun["started_at"])
    if expected is None:
        expected = spark.createDataFrame([], _EXPECTED)

    def published(name: str, schema: str) -> DataFrame:
        """What earlier runs published; a resumed run must not see its own rows as history."""
        found = store.read_all(name)
        if found is None:
            return spark.createDataFrame([], f"run_no bigint, {schema}").drop("run_no")
        return found.where(F.col("run_no") < run_no).drop("run", "run_no")

    history, chain = published("entries", _ENTRIES), published("chain", _CHAIN)

    files = steps.step("files", lambda: list_files().select(*BY, *digests.STAT_KEY))
    stored_at = f"{store.path}/digests"
    steps.once(
        "reading",
        lambda: _read(
            spark, files, expected, root, stored_at, primary, bucket_bytes, wave_buckets
        ),
    )
    again = steps.step("listed-again", lambda: list_files().select(*BY, *digests.STAT_KEY))

    def in_order() -> DataFrame:
        changed = digests.changed_after_read(files, again, BY)
        added = digests.changed_after_read(again, files, BY)
        return _blocked(changed.unionByName(added).distinct(), " files changed while being read: ")

    unstable = steps.step("changed-after-read", in_order)
    steady = files.join(unstable.select(*BY), list(BY), "left_anti")

    wanted = digests.wanted_formats(steady, expected, BY, primary)
    good = _good(spark, stored_at)

    def read_digests() -> DataFrame:
        rows = digests.reuse_digests(wanted, good, BY) if good is not None else wanted.withColumn(
            "digest", F.lit(None).cast("string")
        )
        return rows.select(*BY, "rel_path", "fmt", "digest")

    read = steps.step("digests", read_digests)

    result: list[jobs.Result] = []

    def sealed() -> jobs.Result:
        if not result:
            result.append(jobs.seal(steady, read, expected, history, primary, BY))
        return result[0]

    entries = steps.step("entries", lambda: sealed().entries)
    rows = steps.step("sealed", lambda: sealed().sealed)
    judged = steps.step("judged", lambda: sealed().outcome)
    items = steps.step("review-items", lambda: sealed().review_items)

    def complete() -> DataFrame:
        writing = judged.where("writes_generation").select(*BY)
        mine = [
            df.select(*BY, "rel_path").join(writing, list(BY), "left_semi") for df in (steady, history)
        ]
        return generations.completeness_check(
            entries, mine[0], mine[1], entries.withColumn("problem", F.lit(None).cast("string")),
            primary, BY,
        )

    lacking = steps.step("completeness", complete).where(~F.col("complete")).select(
        *BY,
        F.lit("the generation would not be complete").alias("review_reason"),
        F.lit("error").alias("blocked"),
    )
    stops = unstable.unionByName(lacking)
    numbered = steps.step(
        "numbers",
        lambda: generations.number_generations(
            judged.where("writes_generation")
            .select(*BY)
            .join(stops.select(*BY), list(BY), "left_anti")
            .withColumn("created_at", started_at),
            chain,
            BY,
        ),
    )
    of_generation = numbered.select(*BY, "generation_no", "manifest")
    written = entries.join(of_generation, list(BY))
    folders = steps.step(
        "folders",
        lambda: rollup.directory_hashes(
            written.where(F.col("fmt") == primary).select(*BY, "rel_path", "digest"), primary, BY
        ).join(of_generation, list(BY)),
    )
    stat = rows.select(*BY, "rel_path", "size", "mtime_ns")
    with_stat = steps.step("entries-with-stat", lambda: written.join(stat, [*BY, "rel_path"]))

    def manifest_files() -> DataFrame:
        heads = numbered.withColumns(
            {
                "hostname": F.lit(maker.hostname),
                "tool": F.lit(maker.tool),
                "tool_version": F.lit(maker.tool_version),
                "patterns": F.array(*map(F.lit, maker.patterns)).cast("array<string>"),
            }
        )
        lines = export.manifest_lines(
            heads, with_stat, folders.withColumn("fmt", F.lit(primary)), by=BY
        )
        return export.write_lines(lines, manifests)

    made = steps.step("manifests", manifest_files)
    path = F.concat_ws("/", *BY, F.lit(HISTORY_DIR), F.col("manifest")).alias("path")
    links = steps.step(
        "chain",
        lambda: of_generation.withColumn("path", path)
        .join(made, "path")
        .select(*BY, "generation_no", "manifest", "bytes", "c4"),
    )

    def whole_chains() -> DataFrame:
        touched = links.select(*BY)
        return chain.join(touched, list(BY), "left_semi").unionByName(links)

    steps.step("chain-files", lambda: export.write_lines(export.chain_lines(whole_chains(), BY), manifests))

    def outcome() -> DataFrame:
        totals = files.groupBy(*BY).agg(
            F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes")
        )
        reasons = judged.select(
            *BY, "review_reason", F.when(~F.col("writes_generation"), F.col("state")).alias("blocked")
        ).join(stops.select(*BY), list(BY), "left_anti").unionByName(stops)
        return (
            totals.join(reasons, list(BY), "left")
            .join(of_generation, list(BY), "left")
            .select(
                *BY,
                F.coalesce("blocked", F.lit("sealed")).alias("state"),
                "review_reason",
                F.col("generation_no").isNotNull().alias("writes_generation"),
                "files",
                "bytes",
                "generation_no",
                "manifest",
            )
        )

    ended = steps.step("outcome", outcome)

    def work() -> DataFrame:
        """How each project's work item ends: done, failed, or handed to review."""
        subject = ended.select(
            F.col("project").alias("id"), "state",
            F.coalesce("generation_no", F.lit(0)).alias("last_generation_no"),
        )
        asked = subject.select(
            "id", F.col("id").alias("project_id"), F.lit("seal").alias("kind")
        )
        read_files = ended.select(
            F.col("project").alias("id"),
            F.when(F.col("state") == "error", "error").otherwise("ok").alias("status"),
        )
        return planning.work_outcome(asked, read_files, subject)

    def own(df: DataFrame) -> DataFrame:
        return df.withColumns({"run": F.lit(run), "run_no": F.lit(run_no)})

    kept = of_generation.select(*BY)
    steps.once(
        "published",
        lambda: store.publish(
            {
                "outcome": own(ended),
                "entries": own(with_stat.drop("manifest")),
                "folders": own(folders.drop("manifest")),
                "sealed": own(rows.join(kept, list(BY), "left_semi")),
                "chain": own(links),
                "review_items": own(items),
                "work": own(work()),
            },
            run=run,
        ),
    )
    return store.read_all("outcome").where(F.col("run") == run)


def latest(store: TableSet, name: str, by: Sequence[str] = BY) -> DataFrame | None:
    """The rows of each project's last publish of a table (``sealed``, ``outcome``, ``folders``)."""
    rows = store.read_all(name)
    if rows is None:
        return None
    last = rows.groupBy(*by).agg(F.max("run_no").alias("run_no"))
    return rows.join(last, [*by, "run_no"], "left_semi")
