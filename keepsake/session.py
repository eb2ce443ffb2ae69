"""Session settings and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keepsake", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on; everything else is the cluster's business."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a full URI; one with a scheme is one already."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return path
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(found).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, as a full URI.

    A path without a scheme lies in the cluster's default file system, which only Spark knows; the
    URI means the same to Spark and to the tasks that open files themselves. Unset, a local session
    takes a folder below its warehouse; a cluster session is refused.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/__staged"
    full = qualified(spark, configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(full)
    return full


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    base = shared_folder(spark).rstrip("/")
    return f"{base}/keepsake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def mark(spark: SparkSession, path: str) -> None:
    """An empty file that says that something is done."""
    system, found = _file_system(spark, path)
    system.create(found, True).close()


def marked(spark: SparkSession, path: str) -> bool:
    system, found = _file_system(spark, path)
    return system.exists(found)


def stage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and fixes the row placement."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), files: int | None = None
) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (keeps column pruning).

    ``files`` is how many tasks write at most: else few rows make as many files as there are shuffle
    partitions, and for each file Hadoop's local file system starts processes of its own.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = (df.coalesce(files) if files else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
