"""Text of reports: path lists, sizes, dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import LISTED_PATHS
from keepsake.operators.running import first_rows

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")  # fixed values, decimal


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A small constant table as one expression."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def path_lists(
    df: DataFrame,
    by: Sequence[str],
    path: str = "rel_path",
    n: int = LISTED_PATHS,
    **measures: Column,
) -> DataFrame:
    """Per key: ``n_paths``, ``listed`` (the first ``n`` paths and how many more) and ``measures``.

    Counts are combined before their shuffle and the paths cut to ``n`` per task before theirs, so
    a key with a third of the rows costs no more than any other.
    """
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_paths"), *[m.alias(name) for name, m in measures.items()]
    )
    shown = (
        first_rows(df.select(*by, path), by, [path], n)
        .groupBy(*by)
        .agg(F.array_join(F.array_sort(F.collect_list(path)), ", ").alias("listed"))
    )
    more = F.col("n_paths") - n
    return counts.join(shown, list(by)).withColumn(
        "listed",
        F.when(more > 0, F.concat("listed", F.lit(" (+"), more.cast("string"), F.lit(" more)")))
        .otherwise(F.col("listed")),
    )


def human_size(size: Column) -> Column:
    """Decimal units with one digit; exact ties round to even."""
    value = size.cast("double")

    def scaled(power: int) -> Column:
        number = F.call_function("format_number", value / 1000.0**power, F.lit("0.0"))
        return F.concat(number, F.lit(f" {UNITS[power]}"))

    out = scaled(5)
    for power in range(4, 0, -1):
        out = F.when(F.abs(value) < 1000.0 ** (power + 1), scaled(power)).otherwise(out)
    out = F.when(F.abs(value) < 1000, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)
    return F.when(size.isNull(), "-").otherwise(out)


def short_digest(digest: Column) -> Column:
    return (
        F.when(digest.isNull() | (digest == ""), "-")
        .when(F.length(digest) <= 12, digest)
        .otherwise(F.concat(F.substring(digest, 1, 4), F.lit("…"), F.right(digest, F.lit(4))))
    )


def joined(parts: Sequence[Column], separator: str) -> Column:
    """Non-null parts in order."""
    return F.concat_ws(separator, *parts)


def counted(count: Column, word: str) -> Column:
    """``3 corrupt``, or null for a zero count."""
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {word}")))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
