"""Named queries: what Spark runs and, where SQL can say it, the same result as one statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from keepsake.plans.fixtures import Fixtures, as_ctes

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(needs: tuple[str, ...] = (), sql: str | None = None, ctes: str = "") -> Callable:
    """Register a query under its function's name.

    ``needs`` are the views the SQL reads; ``ctes`` more named steps to put after them.
    """

    def add(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        name = build.__name__
        _QUERIES[name] = build
        if sql is not None:
            head = as_ctes(needs)
            if ctes:
                head = (head.rstrip() + ",\n" if head else "with ") + ctes + "\n"
            _SQL[name] = head + sql
        return build

    return add


def _comparable(df: DataFrame) -> DataFrame:
    """Instants leave as zone-less UTC times."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _comparable(build(Fixtures(spark, sf_dir)))

    return {name: bind(build) for name, build in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
