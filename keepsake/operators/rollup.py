"""Directory hashes, bottom-up.

``content`` of a folder is the hash of its children's sorted hashes, ``structure`` the hash of the
sorted hashes of (name, child hash). The depth loop runs on the driver but holds no data: it has
as many steps as the tree has levels, every file is shuffled once, and each level's result is
staged. A folder is hashed from one array only if its child count is below ``small_folder``; a
larger one goes through :func:`_hash_large`, which never holds its children in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.hashing import HASHERS, check_formats, digest
from keepsake.functions.paths import ancestors, basename, depth, parent
from keepsake.session import stage, stage_table

HEX_FORMATS = ("xxh128", "xxh64", "xxh3", "md5", "sha1")
SMALL_FOLDER = 10_000
RUN = 256  # child hashes per packed row of a large folder
BROADCAST_FOLDERS = 100_000  # large folders of one level that are still broadcast


def _named(name: Column, child: Column, fmt: str) -> Column:
    return digest(F.concat(F.encode(name, "UTF-8"), F.unhex(child)), fmt)


def _sorted_bytes(items: str) -> Column:
    return F.unhex(F.array_join(F.array_sort(F.collect_list(items)), ""))


def directory_hashes(
    files: DataFrame,
    fmt: str,
    by: Sequence[str] = ("project",),
    small_folder: int = SMALL_FOLDER,
) -> DataFrame:
    """``(project, rel_path, content, structure)`` per folder; the project root is ``""``.

    ``files`` has ``project, rel_path, digest`` (hex of ``fmt``, not null).
    """
    check_formats([fmt], HEX_FORMATS)
    by = list(by)
    path = F.col("rel_path")
    children = files.select(
        *by,
        parent(path).alias("folder"),
        F.col("digest").alias("content"),
        _named(basename(path), F.col("digest"), fmt).alias("structure"),
        depth(path).alias("depth"),
    )
    children = stage_table(children, "children", ("depth",))
    folder_depth = F.when(F.col("folder") == "", 0).otherwise(depth(F.col("folder")) + 1)
    parents = children.groupBy(*by, "folder").agg(F.count(F.lit(1)).alias("n"))
    folders = (
        parents.select(*by, F.explode(F.array_append(ancestors(F.col("folder")),
                                                     F.col("folder"))).alias("folder"))
        .where(F.col("folder") != "")
        .distinct()
    )
    subfolders = folders.groupBy(*by, parent(F.col("folder")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n")
    )
    large = stage(
        parents.unionByName(subfolders)
        .groupBy(*by, "folder")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > small_folder)
        .select(*by, "folder", folder_depth.alias("depth"))
    )
    deepest = children.agg(F.max("depth")).first()[0]
    large_at = {r["depth"]: r["count"] for r in large.groupBy("depth").count().collect()}
    done: DataFrame | None = None
    below: DataFrame | None = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        items = children.where(F.col("depth") == level).drop("depth")
        if below is not None:
            items = items.unionByName(below)
        if level in large_at:
            mark = large.where(F.col("depth") == level).drop("depth")
            if large_at[level] <= BROADCAST_FOLDERS:
                mark = F.broadcast(mark)
            few = items.join(mark, [*by, "folder"], "left_anti")
            if large_at[level] > BROADCAST_FOLDERS:
                # A shuffle of its own lets the join before it split a crowded folder.
                few = few.repartition(*[F.col(c) for c in (*by, "folder")])
            many = items.join(mark, [*by, "folder"], "left_semi")
            hashed = _hash_small(few, fmt, by).unionByName(_hash_large(many, fmt, by))
        else:
            hashed = _hash_small(items, fmt, by)
        hashed = stage(hashed)
        done = hashed if done is None else done.unionByName(hashed)
        below = hashed.where(F.col("folder") != "").select(
            *by,
            parent(F.col("folder")).alias("folder"),
            "content",
            _named(basename(F.col("folder")), F.col("structure"), fmt).alias("structure"),
        )
    if done is None:
        done = children.select(*by, "folder", "content", "structure")
    return done.withColumnRenamed("folder", "rel_path")


def _hash_small(items: DataFrame, fmt: str, by: list[str]) -> DataFrame:
    packed = items.groupBy(*by, "folder").agg(
        _sorted_bytes("content").alias("content"), _sorted_bytes("structure").alias("structure")
    )
    return packed.select(
        *by,
        "folder",
        digest(F.col("content"), fmt).alias("content"),
        digest(F.col("structure"), fmt).alias("structure"),
    )


def _hash_large(items: DataFrame, fmt: str, by: list[str]) -> DataFrame:
    """The same hashes for folders with any number of children.

    Equal child hashes are counted first, the distinct ones are range-partitioned and sorted over
    the cluster, runs of them are packed into one row, and each folder's packed rows pass through
    one hash state in order, a batch at a time.
    """
    key = [*by, "folder", "kind"]
    long = items.select(
        *by,
        "folder",
        F.explode(
            F.array(
                F.struct(F.lit("content").alias("kind"), F.col("content").alias("item")),
                F.struct(F.lit("structure").alias("kind"), F.col("structure").alias("item")),
            )
        ).alias("one"),
    ).select(*by, "folder", "one.kind", "one.item")
    counted = long.groupBy(*key, "item").agg(F.count(F.lit(1)).alias("times"))
    ordered = counted.repartitionByRange(*key, "item").sortWithinPartitions(*key, "item")
    text = ", ".join(f"`{c}` string" for c in key)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, rows in batch.groupby(key, sort=False, dropna=False):
                first, held = None, []
                for item, times in zip(rows["item"], rows["times"], strict=True):
                    if times > RUN:
                        if held:
                            out.append([*group, first, 0, b"".join(held), 1])
                        raw = bytes.fromhex(item)
                        out.append([*group, item, 1, raw, int(times)])
                        first, held = None, []
                        continue
                    first = first or item
                    held.extend([bytes.fromhex(item)] * int(times))
                    if len(held) >= RUN:
                        out.append([*group, first, 0, b"".join(held), 1])
                        first, held = None, []
                if held:
                    out.append([*group, first, 0, b"".join(held), 1])
            yield pd.DataFrame(out, columns=[*key, "first", "seq", "data", "times"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                group = tuple(row[: len(key)])
                if group != current:
                    if current is not None:
                        out.append([*current, state.hexdigest()])
                    current, state = group, HASHERS[fmt]()
                block, left = row.data * min(row.times, RUN), row.times
                while left > 0:
                    step = min(left, RUN)
                    state.update(block[: step * len(row.data)])
                    left -= step
            yield pd.DataFrame(out, columns=[*key, "hash"])
        if current is not None:
            yield pd.DataFrame([[*current, state.hexdigest()]], columns=[*key, "hash"])

    packed = ordered.mapInPandas(
        pack, f"{text}, first string, seq int, data binary, times bigint"
    )
    hashed = (
        packed.repartition(*key)
        .sortWithinPartitions(*key, "first", "seq")
        .mapInPandas(fold, f"{text}, hash string")
    )
    return hashed.groupBy(*by, "folder").agg(
        F.max(F.when(F.col("kind") == "content", F.col("hash"))).alias("content"),
        F.max(F.when(F.col("kind") == "structure", F.col("hash"))).alias("structure"),
    )
