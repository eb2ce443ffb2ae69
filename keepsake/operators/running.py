"""Running aggregates and row numbers per key, with no key confined to one task.

``Window.partitionBy(key)`` sends every row of a key to one task, which a key holding a third of
the table turns into the whole run. Here the rows are range-partitioned on *key and order*, so a
large key spreads over as many segments as it needs. Each segment is aggregated on its own and
what it inherits from the earlier (or later) segments of the same key is added afterwards. Only a
key that crosses a segment border inherits anything: at most one per border and direction, so
that table has fewer rows than there are partitions and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import stage

_SEGMENT = "__segment"
_ALL = "__all"


@dataclass(frozen=True)
class Running:
    """One measure: ``how`` is count, sum, max or min; ``span`` is which rows it covers."""

    how: str
    value: Column
    span: str = "upto"  # upto: through this row; before / after: strictly

    def over_all(self) -> Column:
        return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[self.how](self.value)

    def combine(self, left: Column, right: Column) -> Column:
        if self.how in ("count", "sum"):
            return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
        return (F.greatest if self.how == "max" else F.least)(left, right)


def sort_columns(order: Sequence[str], flip: bool = False) -> list[Column]:
    """``"name"`` ascending, ``"-name"`` descending; nulls sort as the smallest value."""
    out = []
    for item in order:
        name, descending = item.lstrip("-"), item.startswith("-") != flip
        out.append(F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first())
    return out


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], **measures: Running
) -> DataFrame:
    """Add one column per measure. ``order`` must be total within a key."""
    keys = list(keys)
    placed = stage(
        df.repartitionByRange(*sort_columns(keys), *sort_columns(order))
        .withColumn(_SEGMENT, F.spark_partition_id())
        .withColumn(_ALL, F.lit(0))
    )
    within = [_SEGMENT, *keys]
    totals = placed.groupBy(_ALL, *within).agg(
        *[m.over_all().alias(f"__total_{name}") for name, m in measures.items()]
    )
    inherited = {name: _inherit(m, f"__total_{name}", keys) for name, m in measures.items()}
    carried = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in within],
        *[column.alias(f"__in_{name}") for name, column in inherited.items()],
    ).where(" or ".join(f"`__in_{name}` is not null" for name in measures))
    local = placed.select(
        "*", *[_local(m, within, order).alias(f"__here_{name}") for name, m in measures.items()]
    )
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = local.join(F.broadcast(carried), same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            m.combine(F.col(f"__here_{name}"), F.col(f"__in_{name}")).alias(name)
            for name, m in measures.items()
        ],
    )


def _inherit(measure: Running, total: str, keys: list[str]) -> Column:
    after = measure.span == "after"
    segments = Window.partitionBy(_ALL, *keys).orderBy(
        F.col(_SEGMENT).desc() if after else F.col(_SEGMENT)
    ).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[measure.how]
    return merge(total).over(segments)


def _local(measure: Running, within: list[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*within).orderBy(*sort_columns(order, measure.span == "after"))
    last = 0 if measure.span == "upto" else -1
    return measure.over_all().over(window.rowsBetween(Window.unboundedPreceding, last))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """1, 2, 3… within each key."""
    return running(df, keys, order, **{name: Running("count", F.lit(1))})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (a report's top-k).

    Catalyst turns the bound on ``row_number`` into a group limit before the shuffle, so each
    task sends at most ``n`` rows per key.
    """
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")
