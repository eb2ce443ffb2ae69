"""Manifest history as tables: one row per generation, one per ``(generation, path, fmt)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.config import CHAIN_FILE, HISTORY_DIR, MANIFEST_FORMATS
from keepsake.functions.paths import basename, parent
from keepsake.functions.text import counted, joined
from keepsake.operators.running import Running, running

BY = ("project",)


def first_digests(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``recorded map<fmt, first digest>`` per path, from one aggregation.

    Failed entries never serve as a reference.
    """
    if "action" in history.columns:
        history = history.where(F.coalesce("action", F.lit("")) != "failed")
    firsts = [
        F.min(
            F.when(F.col("fmt") == fmt, F.struct("generation_no", "digest"))
        )["digest"].alias(f"__{fmt}")
        for fmt in MANIFEST_FORMATS
    ]
    pairs = F.array(
        *[F.struct(F.lit(f).alias("k"), F.col(f"__{f}").alias("v")) for f in MANIFEST_FORMATS]
    )
    return history.groupBy(*by, "rel_path").agg(*firsts).select(
        *by,
        "rel_path",
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("recorded"),
    )


def assign_actions(
    new: DataFrame,
    history: DataFrame,
    inherited: Sequence[str] | Column = (),
    by: Sequence[str] = BY,
) -> DataFrame:
    """``action`` (original, verified, failed) and ``problem`` of every new ``(path, fmt)``.

    ``inherited`` are the formats already checked against an origin manifest: a list, or an
    array column of ``new``.
    """
    file = [*by, "rel_path"]
    rows = new.join(first_digests(history, by), file, "left")
    inherits = (
        F.array_contains(inherited, F.col("fmt"))
        if isinstance(inherited, Column)
        else F.col("fmt").isin(*inherited)
        if inherited
        else F.lit(False)
    )
    known = F.col("recorded").isNotNull()
    first = F.try_element_at("recorded", F.col("fmt"))
    same = first == F.col("digest")
    of_file = Window.partitionBy(*file)  # at most one row per format
    rows = rows.withColumns(
        {
            "__inherits": inherits,
            "__verified": F.max(F.coalesce(same, F.lit(False))).over(of_file),
            "__given": F.max(first.isNotNull()).over(of_file),
            "__all_inherited": F.min(inherits).over(of_file),
        }
    )
    action = (
        F.when(~known, F.when(F.col("__inherits"), "verified").otherwise("original"))
        .when(first.isNotNull(), F.when(same, "verified").otherwise("failed"))
        .otherwise(F.when(F.col("__verified"), "verified").otherwise("failed"))
    )
    problem = (
        F.when(known & ~F.col("__given"), "none of the recorded formats was given")
        .when(~known & F.col("__all_inherited"), "at least one format must be original")
        .when(action == "failed", "hash mismatch")
    )
    return rows.select(*new.columns, action.alias("action"), problem.alias("problem"))


def completeness_check(
    given: DataFrame,
    present: DataFrame,
    recorded: DataFrame,
    actions: DataFrame,
    directory_format: str,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Per project, what stands against a full generation; ``complete`` iff nothing does.

    ``given`` are the digests to record (with ``fmt``), ``present`` the files on disk, ``recorded``
    the paths of the history, ``actions`` the result of :func:`assign_actions`.
    """
    file = [*by, "rel_path"]
    none = F.lit(0).cast("bigint")

    def flags(df: DataFrame, **hit: Column) -> DataFrame:
        names = ("given", "present", "recorded", "has_format", "failed")
        return df.select(*file, *[hit.get(n, F.lit(False)).alias(n) for n in names])

    rows = (
        flags(given, given=F.lit(True), has_format=F.col("fmt") == directory_format)
        .unionByName(flags(present, present=F.lit(True)))
        .unionByName(flags(recorded, recorded=F.lit(True)))
        .unionByName(flags(actions, failed=F.col("problem").isNotNull()))
    )
    names = ("given", "present", "recorded", "has_format", "failed")
    per_file = rows.groupBy(*file).agg(*[F.max(n).alias(n) for n in names])
    out = per_file.groupBy(*by).agg(
        F.count_if(F.col("present") & ~F.col("given")).alias("without_digest"),
        F.count_if(F.col("given") & ~F.col("present")).alias("not_on_disk"),
        F.count_if(F.col("recorded") & ~F.col("present")).alias("gone"),
        F.count_if(F.col("given") & ~F.col("has_format")).alias("lacks_format"),
        F.count_if(F.col("failed")).alias("failures"),
    )
    counts = ("without_digest", "not_on_disk", "gone", "lacks_format", "failures")
    total = sum((F.coalesce(c, none) for c in counts), F.lit(0))
    return out.withColumn("complete", total == 0)


def partial_generation(
    digests: DataFrame,
    added: DataFrame,
    history: DataFrame,
    inherited: Sequence[str] | Column = (),
    by: Sequence[str] = BY,
) -> DataFrame:
    """Entries of an append generation: the given digests of added files only, no directories."""
    wanted = added.select(*by, "rel_path").distinct()
    given = digests.join(wanted, [*by, "rel_path"], "left_semi")
    return assign_actions(given, history, inherited, by).withColumn("is_full", F.lit(False))


def number_generations(
    pending: DataFrame, chain: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Next ``generation_no`` and the manifest's file name.

    ``pending`` has one row per project with ``created_at``; ``chain`` has ``generation_no``.
    """
    last = chain.groupBy(*by).agg(F.max("generation_no").alias("__last"))
    number = (F.coalesce("__last", F.lit(0)) + 1).cast("int")
    folder = basename(F.col(by[-1]).cast("string"))
    stamp = F.date_format("created_at", "yyyy-MM-dd_HHmmss")
    return (
        pending.join(last, list(by), "left")
        .withColumn("generation_no", number)
        .withColumn("manifest", F.format_string("%04d_%s_%sZ.mhl", number, folder, stamp))
        .drop("__last")
    )


def generation_bounds(generations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each generation with the last full one before it, the next full one after it, and ``rank``."""
    full = F.when(F.col("is_full"), F.col("generation_no"))
    return running(
        generations.select(*by, "generation_no", "is_full"),
        by,
        ["generation_no"],
        last_full=Running("max", full, "before"),
        next_full=Running("min", full, "after"),
        rank=Running("count", F.lit(1)),
    )


def history_diff(
    generations: DataFrame, entries: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Per generation after the first: files it lists, and how many are new, modified, removed.

    A generation is compared with the state known so far: everything since the last full one. A
    path is known if its previous entry is not older than that, and it is removed by the next full
    generation after its entry if nothing lists it in between. Both are questions about a path's
    neighbouring entries, so the file rows are shuffled once, on ``(project, rel_path)``.
    """
    key = [*by, "generation_no"]
    bounds = generation_bounds(generations, by)
    rows = entries.join(bounds.select(*key, "last_full", "next_full"), key).repartition(
        *[F.col(c) for c in (*by, "rel_path")]
    )
    one = rows.groupBy(*by, "rel_path", "generation_no", "last_full", "next_full").agg(
        F.map_from_entries(F.collect_list(F.struct("fmt", "digest"))).alias("digests")
    )
    of_path = Window.partitionBy(*by, "rel_path").orderBy("generation_no")
    seen = one.withColumns(
        {
            "before": F.lag("generation_no").over(of_path),
            "earlier": F.lag("digests").over(of_path),
            "after": F.lead("generation_no").over(of_path),
        }
    )
    known = F.col("before").isNotNull() & (F.col("before") >= F.coalesce("last_full", F.lit(0)))
    changed = F.exists(
        F.map_entries("digests"),
        lambda e: F.coalesce(F.try_element_at("earlier", e["key"]) != e["value"], F.lit(False)),
    )
    dropped = F.col("next_full").isNotNull() & (
        F.col("after").isNull() | (F.col("after") > F.col("next_full"))
    )
    effects = seen.select(
        *by,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(
                        F.col("generation_no"),
                        F.when(~known, "new").when(changed, "modified").otherwise("same")
                        .alias("effect"),
                    ),
                    F.when(
                        dropped,
                        F.struct(F.col("next_full").alias("generation_no"),
                                 F.lit("removed").alias("effect")),
                    ),
                )
            )
        ).alias("one"),
    ).select(*by, "one.generation_no", "one.effect")
    counts = effects.groupBy(*key).agg(
        F.count_if(F.col("effect") != "removed").alias("files"),
        *[F.count_if(F.col("effect") == e).alias(e) for e in ("new", "modified", "removed")],
    )
    zero = F.lit(0).cast("bigint")
    names = ("files", "new", "modified", "removed")
    out = bounds.where(F.col("rank") > 1).join(counts, key, "left")
    return out.select(*key, "is_full", *[F.coalesce(n, zero).alias(n) for n in names]).withColumn(
        "changes", changes_text()
    )


def changes_text() -> Column:
    new = F.when(F.col("new") > 0, F.concat(F.lit("+"), F.col("new").cast("string"), F.lit(" new")))
    text = joined(
        [new, counted(F.col("modified"), "modified"), counted(F.col("removed"), "removed")], " · "
    )
    return F.when(text == "", "no changes").otherwise(text)


def current_from_history(
    generations: DataFrame, entries: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """The recorded state: each path's latest entry since the last full generation."""
    last_full = generations.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("is_full"), F.col("generation_no"))), F.lit(0)).alias("since")
    )
    # The latest entry decides, so paths are reduced first, spread by path; a join on the project
    # before that would gather each project in one task.
    latest = entries.groupBy(*by, "rel_path").agg(
        F.max(F.struct("generation_no", "digest")).alias("last")
    )
    return (
        latest.select(*by, "rel_path", "last.generation_no", "last.digest")
        .join(last_full, list(by))
        .where(F.col("generation_no") >= F.col("since"))
        .drop("since")
    )


def orphan_manifests(
    listing: DataFrame, chain: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Manifests in the history folder that the chain does not list.

    ``listing`` has project-relative ``rel_path``; ``chain`` has ``manifest`` file names.
    """
    name = basename(F.col("rel_path"))
    manifests = listing.where(
        (parent(F.col("rel_path")) == HISTORY_DIR) & name.endswith(".mhl") & ~name.startswith("._")
    ).withColumn("manifest", name)
    listed = chain.select(*by, basename(F.col("manifest")).alias("manifest"))
    return manifests.join(listed, [*by, "manifest"], "left_anti").select(*by, "manifest")


def verify_chain(chain: DataFrame, on_disk: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``status`` per chain entry: ok, mismatch, or missing.

    ``chain`` has ``manifest, c4``; ``on_disk`` the C4 of each manifest's bytes as ``actual``.
    """
    found = on_disk.select(*by, "manifest", "actual")
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("c4"), "ok")
        .otherwise("mismatch")
    )
    return chain.join(found, [*by, "manifest"], "left").withColumn("status", status)


def archive_references(
    projects: DataFrame, generations: DataFrame, chains: DataFrame | None = None
) -> DataFrame:
    """``(rel_path, manifest, c4)``: the latest manifest of every referenced project.

    ``projects`` has ``id, rel_path, state, last_generation_no``; ``generations`` has ``id``,
    ``generation_no, manifest, c4``; ``chains`` lists the ``id`` of projects with a chain on disk.
    """
    latest = generations.groupBy("id").agg(
        F.max(F.struct("generation_no", "manifest", "c4")).alias("last")
    )
    kept = projects.where(
        F.col("last_generation_no").isNotNull() & ~F.col("state").isin("ignored", "missing")
    )
    if chains is not None:
        kept = kept.join(chains.select("id").distinct(), "id", "left_semi")
    path = F.concat("rel_path", F.lit(f"/{HISTORY_DIR}/"), F.col("last.manifest"))
    return kept.join(latest, "id").select(
        "id", "rel_path", path.alias("manifest"), F.col("last.c4").alias("c4")
    )


def references_stale(
    referenced: DataFrame, recorded: DataFrame, flag_set: bool, has_root_history: bool
) -> DataFrame:
    """One row: how the referenced set differs from the recorded one and whether to renew it."""
    sides = referenced.select("rel_path", F.lit(True).alias("now")).join(
        recorded.select("rel_path", F.lit(True).alias("before")), "rel_path", "full_outer"
    )
    out = sides.agg(
        F.count_if("now").alias("referenced"),
        F.count_if(F.col("now") & F.col("before").isNull()).alias("to_add"),
        F.count_if(F.col("before") & F.col("now").isNull()).alias("to_drop"),
    )
    forced = flag_set or not has_root_history
    return out.withColumn(
        "needed",
        (F.col("referenced") > 0) & (F.lit(forced) | (F.col("to_add") + F.col("to_drop") > 0)),
    )


def dangling_references(references: DataFrame, listing: DataFrame) -> DataFrame:
    """References (archive-relative ``path``) whose manifest is gone."""
    return references.join(listing.select("path"), "path", "left_anti")


def sync_history(
    stored: DataFrame, source: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """The stored copy after a sync: ``(project, name, content_id, epoch, superseded)``.

    Manifests never change, so only names the copy lacks are added; the chain is replaced. Where
    the live copy holds a name the source lacks, it belongs to another history: it is set aside
    and the source starts a new epoch. ``stored`` has ``epoch, superseded``. A project without
    source rows keeps its copy.
    """
    visible = source.where(~F.col("name").rlike("(^|/)[.]")).select(
        *by, "name", F.col("content_id").alias("__source")
    )
    live = stored.where(~F.col("superseded"))
    has_source = visible.select(*by).distinct()
    pair = live.join(visible, [*by, "name"], "full_outer").withColumn(
        "__extra", F.col("epoch").isNotNull() & F.col("__source").isNull()
    )
    per_project = (
        pair.groupBy(*by)
        .agg(F.bool_or("__extra").alias("__replaced"), F.max("epoch").alias("__epoch"))
        .join(has_source, list(by), "left_semi")
    )
    rows = pair.join(per_project, list(by), "left").withColumn(
        "__replaced", F.coalesce("__replaced", F.lit(False))
    )
    epoch = F.coalesce("__epoch", "epoch", F.lit(1))
    kept_bytes = F.when(F.col("name") == CHAIN_FILE, F.coalesce("__source", "content_id")).otherwise(
        F.coalesce("content_id", "__source")
    )
    merged = rows.where(~F.col("__replaced")).select(
        *by,
        "name",
        kept_bytes.alias("content_id"),
        epoch.cast("int").alias("epoch"),
        F.lit(False).alias("superseded"),
    )
    renewed = rows.where(F.col("__replaced") & F.col("__source").isNotNull()).select(
        *by,
        "name",
        F.col("__source").alias("content_id"),
        (epoch + 1).cast("int").alias("epoch"),
        F.lit(False).alias("superseded"),
    )
    aside = rows.where(F.col("__replaced") & F.col("epoch").isNotNull()).select(
        *by, "name", "content_id", "epoch", F.lit(True).alias("superseded")
    )
    old = stored.where("superseded").select(*by, "name", "content_id", "epoch", "superseded")
    return old.unionByName(aside).unionByName(merged).unionByName(renewed)


def supersede_history(
    generations: DataFrame, accepted: DataFrame, stamp: Column, by: Sequence[str] = BY
) -> DataFrame:
    """Accepting a new version: live rows of the accepted projects are stamped, never deleted.

    ``generations`` has ``epoch`` and ``superseded_at`` (null while live).
    """
    marks = accepted.select(*by).distinct().withColumn("__accepted", F.lit(True))
    hit = F.col("__accepted").isNotNull() & F.col("superseded_at").isNull()
    return (
        generations.join(marks, list(by), "left")
        .withColumn("superseded_at", F.when(hit, stamp).otherwise(F.col("superseded_at")))
        .drop("__accepted")
    )
