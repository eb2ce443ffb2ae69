"""What a run of several steps has finished, so that a run that died goes on where it stood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.session import mark, marked


class Journal:
    """The steps of one run below ``folder``, which every executor reaches.

    A step's rows are written whole before its mark is; a step without a mark is done again and
    replaces what a dead run left of it. Steps are named, so the order in which they are asked for
    does not matter, and a step is never computed twice once it is marked. One driver at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def finished(self, name: str) -> bool:
        return marked(self.spark, f"{self.folder}/{name}.done")

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The step's rows, read back if it was finished, else computed and written."""
        path = f"{self.folder}/{name}"
        if not self.finished(name):
            build().write.mode("overwrite").parquet(path)
            mark(self.spark, f"{path}.done")
        return self.spark.read.parquet(path)

    def once(self, name: str, act: Callable[[], object]) -> None:
        """Do something that may be repeated harmlessly, and not again once it is marked."""
        if not self.finished(name):
            act()
            mark(self.spark, f"{self.folder}/{name}.done")
