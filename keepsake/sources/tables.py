"""State tables as parquet snapshots: keyed reads, replace, upsert, append and publish."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.config import STATES, WORK_KINDS, WORK_STATES


def read_rows(
    df: DataFrame, order: Sequence[str] = ("rel_path",), **equals: object
) -> DataFrame:
    """Rows with the given values, in order. A list means any of its values."""
    for column, value in equals.items():
        wanted = F.col(column).isin(*value) if isinstance(value, (list, tuple)) else (
            F.col(column) == value
        )
        df = df.where(wanted)
    return df.orderBy(*order)


def require_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Fail the write if ``column`` holds anything else."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    message = F.concat(F.lit(f"unknown {column}: "), F.col(column))
    return df.withColumn(column, F.when(bad, F.raise_error(message)).otherwise(F.col(column)))


def require_states(projects: DataFrame) -> DataFrame:
    return require_values(projects, "state", STATES)


def require_work(work: DataFrame) -> DataFrame:
    return require_values(require_values(work, "kind", WORK_KINDS), "state", WORK_STATES)


def replace_rows(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions ``df`` has rows for and leave every other one alone."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    buckets: int,
    keys: Sequence[str] = ("project", "rel_path"),
) -> DataFrame:
    """Save a snapshot bucketed and sorted by its key.

    Two snapshots with the same buckets are compared without a shuffle. Give about one bucket per
    256 MB; a project with a third of all files still spreads over every bucket.
    """
    (
        df.write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def latest_rows(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key of an append table; ``order`` decides, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    last = log.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest]).select(*log.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next snapshot: rows of ``new`` update the columns they name or are added."""
    unknown = sorted(set(new.columns) - set(old.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    changed = [c for c in new.columns if c not in keys]
    fresh = new.select(
        *keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in changed]
    )
    both = old.withColumn("__old", F.lit(True)).join(fresh, list(keys), "full_outer")

    def value(column: str) -> Column:
        if column in keys or column not in changed:
            return F.col(column)
        return F.when(F.col("__new"), F.col(f"__{column}")).otherwise(F.col(column)).alias(column)

    return both.select(*[value(c) for c in old.columns])


class TableSet:
    """Tables published together below one folder.

    A publish writes new version folders first and then one row to the pointer table. Readers go
    through the pointer, so they see all tables of a publish or none; a failed publish leaves
    folders nobody points at. One writer at a time.
    """

    POINTER = "table string, version string, seq bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.POINTER).parquet(f"{self.path}/pointer")
        except Exception as exc:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    def publish(
        self,
        tables: Mapping[str, DataFrame],
        partition_by: Sequence[str] = (),
        run: str | None = None,
    ) -> None:
        """Publish the tables. With ``run``, the name of the run that made them, exactly once: a
        run published before changes nothing, one that died while writing is written anew."""
        if run is not None and self.published(run):
            return
        version = run or uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            kept = [c for c in partition_by if c in df.columns]
            (writer.partitionBy(*kept) if kept else writer).parquet(f"{self.path}/{name}/{version}")
        rows = [(name, version, self.last_number() + 1) for name in tables]
        self.spark.createDataFrame(rows, self.POINTER).coalesce(1).write.mode("append").parquet(
            f"{self.path}/pointer"
        )

    def last_number(self) -> int:
        """The number of the last publish, 0 before the first."""
        pointer = self._pointer()
        return (pointer.agg(F.max("seq")).first()[0] or 0) if pointer is not None else 0

    def published(self, run: str) -> bool:
        pointer = self._pointer()
        return pointer is not None and not pointer.where(F.col("version") == run).isEmpty()

    def read_all(self, name: str) -> DataFrame | None:
        """The rows of every publish of a table that grows by what each one adds."""
        pointer = self._pointer()
        if pointer is None:
            return None
        versions = [r["version"] for r in pointer.where(F.col("table") == name).collect()]
        return self.read_versions(name, versions) if versions else None

    def read_versions(self, name: str, versions: Sequence[str]) -> DataFrame:
        """The rows of certain publishes of a table; each is a folder of its own."""
        return self.spark.read.parquet(*[f"{self.path}/{name}/{v}" for v in versions])

    def read(self, name: str) -> DataFrame | None:
        """The published version of a table, or None before the first publish."""
        pointer = self._pointer()
        if pointer is None:
            return None
        row = (
            pointer.where(F.col("table") == name)
            .agg(F.max(F.struct("seq", "version")).alias("last"))
            .first()
        )
        if row is None or row["last"] is None:
            return None
        return self.spark.read.parquet(f"{self.path}/{name}/{row['last']['version']}")
