"""Digests recorded where the files came from, checked against what was read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import ORIGIN_FORMATS
from keepsake.functions.paths import basename, parent, resolve

BY = ("project",)


def _hex(value: Column) -> Column:
    return F.lower(F.trim(value))


def _reversed_bytes(value: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(value, F.lit(".."), F.lit(0))), "")


def normalise_origin(entries: DataFrame) -> DataFrame:
    """Entries with project-relative ``rel_path``, ``fmt``, ``digest`` and ``warning``.

    ``entries`` has ``project, manifest`` (project-relative path), ``position``, ``name`` (relative
    to the manifest's folder), ``tag``, ``value``. Rows without a usable digest keep a null ``fmt``
    and say why in ``warning``.
    """
    value = _hex(F.col("value"))
    tag = F.col("tag")
    little_ok = value.rlike("^[0-9a-f]{16}$")
    fmt = F.when(tag.isin("md5", "sha1"), tag).when(
        (tag == "xxhash64be") | ((tag == "xxhash64") & little_ok), "xxh64"
    )
    digest = F.when(tag.isin("md5", "sha1", "xxhash64be"), value).when(
        (tag == "xxhash64") & little_ok, _reversed_bytes(value)
    )
    rel = resolve(parent(F.col("manifest")), F.trim("name"))
    where = F.concat(basename(F.col("manifest")), F.lit(": "), rel)
    warning = F.when(
        tag == "xxhash", F.concat(where, F.lit(": XXH32 (xxhash) has no equivalent, skipped"))
    ).when(
        (tag == "xxhash64") & ~little_ok, F.concat(where, F.lit(": invalid "), tag, F.lit(" value"))
    )
    return entries.select(
        *[c for c in entries.columns if c not in ("name", "tag", "value", "rel_path")],
        rel.alias("rel_path"),
        fmt.alias("fmt"),
        digest.alias("digest"),
        warning.alias("warning"),
    )


def _walk_order() -> Column:
    """A folder's manifests before its subfolders', names sorted, then entry order."""
    return F.struct(
        F.filter(F.split(parent(F.col("manifest")), "/"), lambda p: p != "").alias("folder"),
        basename(F.col("manifest")).alias("file"),
        F.col("position"),
    )


def merge_origin(normalised: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The first digest per ``(path, fmt)``, and how many later entries disagree with it.

    Equal entries are counted before the shuffle, so a file listed again and again costs one row
    per task.
    """
    usable = normalised.where(F.col("fmt").isNotNull())
    values = usable.groupBy(*by, "rel_path", "fmt", "digest").agg(
        F.min(_walk_order()).alias("first"), F.count(F.lit(1)).alias("entries")
    )
    merged = values.groupBy(*by, "rel_path", "fmt").agg(
        F.min(F.struct("first", "digest", "entries")).alias("kept"),
        F.sum("entries").alias("total"),
    )
    return merged.select(
        *by,
        "rel_path",
        "fmt",
        F.col("kept.digest").alias("digest"),
        (F.col("total") - F.col("kept.entries")).cast("bigint").alias("conflicts"),
    )


def origin_conflicts(normalised: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The entries that disagree with the first one, with a warning each."""
    first = merge_origin(normalised, by).where(F.col("conflicts") > 0)
    kept = first.select(*by, "rel_path", "fmt", F.col("digest").alias("kept"))
    rows = normalised.where(F.col("fmt").isNotNull()).join(kept, [*by, "rel_path", "fmt"])
    text = F.concat(
        basename(F.col("manifest")),
        F.lit(": "),
        F.col("rel_path"),
        F.lit(": conflicting "),
        F.col("fmt"),
        F.lit(", kept first"),
    )
    return rows.where(F.col("digest") != F.col("kept")).withColumn("warning", text)


def origin_problems(
    expected: DataFrame,
    present: DataFrame,
    digests: DataFrame,
    ignored_present: DataFrame | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``change`` per origin-listed file that is gone or does not match; files not read are skipped.

    ``ignored_present`` lists files that are there but excluded by the patterns: no problem.
    """
    file = [*by, "rel_path"]
    read = digests.groupBy(*file).agg(
        F.map_from_entries(F.collect_set(F.struct("fmt", "digest"))).alias("got")
    )
    here = present.select(*file, "size", "mtime_ns", F.lit(True).alias("here"))
    supported = F.col("fmt").isin(*ORIGIN_FORMATS)
    got = F.try_element_at("got", F.col("fmt"))
    per_file = (
        expected.select(*file, "fmt", "digest")
        .join(here, file, "left")
        .join(read, file, "left")
        .groupBy(*file)
        .agg(
            F.bool_or("here").alias("here"),
            F.max("size").alias("new_size"),
            F.max("mtime_ns").alias("new_mtime_ns"),
            F.bool_or(
                F.col("got").isNotNull() & supported & ~got.eqNullSafe(F.col("digest"))
            ).alias("mismatch"),
        )
    )
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("mismatch"), "modified")
    out = per_file.withColumn("change", change).where(F.col("change").isNotNull())
    if ignored_present is not None:
        hidden = ignored_present.select(*file).withColumn("change", F.lit("deleted"))
        out = out.join(hidden, [*file, "change"], "left_anti")
    return out.select(*file, "change", "new_size", "new_mtime_ns")


def accept_overrides(
    digests: DataFrame, problems: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Digests to record on accept: a file that no longer matches loses its origin formats."""
    wrong = problems.where(F.col("change") == "modified").select(*by, "rel_path")
    dropped = F.array(*map(F.lit, ORIGIN_FORMATS))
    wrong = wrong.withColumn("fmt", F.explode(dropped))
    return digests.join(wrong, [*by, "rel_path", "fmt"], "left_anti")


def append_scope(expected: DataFrame, diff: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """On append only newly added files answer to their origin."""
    added = diff.where(F.col("change") == "added").select(*by, "rel_path")
    return expected.join(added, [*by, "rel_path"], "left_semi")
