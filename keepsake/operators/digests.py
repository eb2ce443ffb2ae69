"""Reading files once for every wanted format, and reusing what an exact stat already proves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.config import ORIGIN_FORMATS, PRIMARY_FORMAT, READER_FORMATS
from keepsake.functions.hashing import HASHERS, check_formats
from keepsake.operators.running import Running, running
from keepsake.session import stage_table
from keepsake.sources.storage import open_read, stat_of

BLOCK = 8 * 1024 * 1024
MAX_READS = 3
BUCKET_BYTES = 64 * 1024**3  # bytes one task reads before the next bucket starts
OPEN_BYTES = 4 * 1024 * 1024  # what opening a file counts as, so tiny files fill a bucket too
STAT_KEY = ("rel_path", "size", "mtime_ns")


def wanted_formats(
    files: DataFrame,
    origin: DataFrame,
    by: Sequence[str] = ("project",),
    primary: str = PRIMARY_FORMAT,
) -> DataFrame:
    """``fmt`` rows per file: the primary one and the supported ones its origin recorded."""
    base = files.select(*by, *STAT_KEY)
    extra = (
        origin.where(F.col("fmt").isin(*ORIGIN_FORMATS))
        .select(*by, "rel_path", "fmt")
        .distinct()
        .where(F.col("fmt") != primary)
        .join(base, [*by, "rel_path"])
        .select(*by, *STAT_KEY, "fmt")
    )
    return base.withColumn("fmt", F.lit(primary)).unionByName(extra)


def reuse_digests(
    wanted: DataFrame, stored: DataFrame, by: Sequence[str] = ("project",)
) -> DataFrame:
    """``wanted`` with the stored ``digest`` of exactly that path, stat and format, else null."""
    key = [*by, *STAT_KEY, "fmt"]
    return wanted.join(stored.select(*key, "digest"), key, "left")


def to_compute(reused: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """One row per file that has to be read, with the formats one read must produce."""
    return (
        reused.where(F.col("digest").isNull())
        .groupBy(*by, *STAT_KEY)
        .agg(F.array_sort(F.collect_set("fmt")).alias("formats"))
    )


def balance_by_bytes(
    files: DataFrame, by: Sequence[str] = ("project",), bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Files in path order cut into buckets of about ``bucket_bytes``; one task per bucket.

    The running total is computed without a single-task window. Buckets are numbered without gaps
    and a task gets exactly one of them, so it never reads more than a bucket and one file.
    """
    placed, count = _buckets(files, by, bucket_bytes)
    return placed.repartitionById(max(1, count), "bucket")


def _buckets(
    files: DataFrame, by: Sequence[str], bucket_bytes: int
) -> tuple[DataFrame, int]:
    """``files`` with ``bucket`` from 0 on, and the number of buckets."""
    order = [*by, "rel_path"]
    weight = F.col("size") + OPEN_BYTES
    summed = running(files, [], order, __before=Running("sum", weight, "before"))
    cut = F.floor(F.coalesce("__before", F.lit(0)) / F.lit(bucket_bytes)).cast("bigint")
    placed = stage_table(summed.withColumn("__cut", cut).drop("__before"), "buckets")
    # One row per bucket: the archive's bytes over those of a bucket.
    numbers = placed.select("__cut").distinct().withColumn(
        "bucket", F.row_number().over(Window.orderBy("__cut")) - 1
    )
    numbered = placed.join(numbers, "__cut").drop("__cut")
    return numbered, numbers.count()


def read_once(path: str, formats: Sequence[str]) -> tuple[str, str | None, int, int, dict]:
    """``(status, error, size, mtime_ns, digests)`` of one file, read in blocks.

    The stat is compared before and after: a file that kept changing is ``changed``.
    """
    size = mtime = 0
    try:
        for _ in range(MAX_READS):
            size, mtime = before = stat_of(path)
            hashers = {fmt: HASHERS[fmt]() for fmt in formats}
            with open_read(path) as source:
                while block := source.read(BLOCK):
                    for hasher in hashers.values():
                        hasher.update(block)
            if stat_of(path) == before:
                return "ok", None, size, mtime, {f: h.hexdigest() for f, h in hashers.items()}
        return "changed", "file kept changing while being read", size, mtime, {}
    except OSError as exc:
        return "error", exc.strerror or str(exc), size, mtime, {}


def compute_digests(
    files: DataFrame,
    root: str,
    by: Sequence[str] = ("project",),
    formats: Sequence[str] | None = None,
    bucket_bytes: int = BUCKET_BYTES,
    allowed: Sequence[str] = READER_FORMATS,
) -> DataFrame:
    """Read every file below ``root`` (a folder all executors reach) once, all formats together.

    ``files`` has ``project, rel_path, size, mtime_ns`` and, unless ``formats`` is given, an array
    ``formats``. Gives one row per format: ``digest`` and ``status`` ok, changed or error. The
    size and mtime are those the bytes were read under.
    """
    if formats is not None:
        check_formats(formats, allowed)
        files = files.withColumn("formats", F.array(*map(F.lit, formats)))
    else:
        known = F.array(*map(F.lit, allowed))
        files = files.withColumn(
            "formats",
            F.when(F.size(F.array_except("formats", known)) == 0, F.col("formats")).otherwise(
                F.raise_error(F.lit("unsupported hash formats"))
            ),
        )
    keys = list(by)
    placed = balance_by_bytes(files.select(*keys, *STAT_KEY, "formats"), by, bucket_bytes)
    return _read(placed, root, keys)


def _read(placed: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Digest the files of each task, in place order."""
    schema = ", ".join(f"`{k}` string" for k in keys) + (
        ", rel_path string, size bigint, mtime_ns bigint, fmt string, digest string,"
        " status string, error string"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "rel_path", "size", "mtime_ns", "fmt", "digest", "status", "error"]
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                path = f"{root}/{row[keys[-1]]}/{row['rel_path']}"
                wanted = list(row["formats"])
                status, error, size, mtime, found = read_once(path, wanted)
                head = [row[k] for k in keys]
                for fmt in wanted:
                    out.append(
                        [*head, row["rel_path"], size, mtime, fmt, found.get(fmt), status, error]
                    )
            yield pd.DataFrame(out, columns=columns)

    return placed.drop("bucket").mapInPandas(read, schema)


def read_in_waves(
    wanted: DataFrame,
    stored: DataFrame | None,
    root: str,
    append: Callable[[DataFrame], None],
    by: Sequence[str] = ("project",),
    bucket_bytes: int = BUCKET_BYTES,
    wave_buckets: int = 1024,
) -> int:
    """Read what ``stored`` lacks, appending wave after wave; gives the number of waves.

    A run that dies keeps every wave it appended: the next one finds those digests stored and
    starts with the rest. ``wanted`` is the result of :func:`wanted_formats`.
    """
    keys = list(by)
    if stored is None:
        todo = fresh_read(wanted, by)
    else:
        todo = to_compute(reuse_digests(wanted, stored, by), by)
    placed, count = _buckets(todo, by, bucket_bytes)
    placed = stage_table(placed, "buckets")
    starts = range(0, count, wave_buckets)
    for start in starts:
        part = placed.where(F.col("bucket").between(start, start + wave_buckets - 1))
        width = min(wave_buckets, count - start)
        append(_read(part.repartitionById(width, F.col("bucket") - start), root, keys))
    return len(starts)


def fresh_read(wanted: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """What a verification reads: every wanted format of every file, stored digests or not."""
    return to_compute(wanted.withColumn("digest", F.lit(None).cast("string")), by)


def changed_after_read(
    scanned: DataFrame, rescanned: DataFrame, by: Sequence[str] = ("project",)
) -> DataFrame:
    """Scanned files whose stat is no longer the scanned one."""
    return scanned.join(rescanned.select(*by, *STAT_KEY), [*by, *STAT_KEY], "left_anti")


def prune_digests(
    stored: DataFrame, current: DataFrame, by: Sequence[str] = ("project",)
) -> DataFrame:
    """Stored digests whose path and stat are still current."""
    return stored.join(current.select(*by, *STAT_KEY), [*by, *STAT_KEY], "left_semi")


def progress_percent(done: str, total: str, files_done: str, files_total: str):
    """Floor percent by bytes, else by files, else 0; at most 100."""

    def share(part: str, whole: str):
        return F.least(F.lit(100), F.floor(F.col(part) * 100 / F.col(whole))).cast("bigint")

    return (
        F.when(F.col(total) > 0, share(done, total))
        .when(F.col(files_total) > 0, share(files_done, files_total))
        .otherwise(F.lit(0).cast("bigint"))
    )


def read_progress(items: DataFrame, read: DataFrame, by: Sequence[str] = ("item",)) -> DataFrame:
    """Files and bytes done and in total per work item.

    ``items`` lists the files of each item, ``read`` those already digested (``rel_path``).
    """
    done = read.select(*by, "rel_path").distinct().withColumn("__done", F.lit(True))
    rows = items.join(done, [*by, "rel_path"], "left")
    hit = F.col("__done").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count_if(hit).alias("files_done"),
        F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).cast("bigint").alias("bytes_done"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes_total"),
    )
    return out.withColumn(
        "percent", progress_percent("bytes_done", "bytes_total", "files_done", "files_total")
    )
