"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that a task handles at once, so that a batch of very long texts stays small.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()``, kept in a Python worker for later tasks until they ask for another key; a
    worker keeps one such object, so a stage does not pay for what an earlier one used."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``work()``, made once per task, to small record batches of ``df``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in slices(batches):
            one = one or work()
            yield one(batch)

    return df.mapInArrow(task, schema)


def in_tasks(files: DataFrame, per_task: int = 1) -> DataFrame:
    """``files`` (a written table, one short row per file) dealt to one task per ``per_task`` files.

    The number is given to Spark, which would else see a few kilobytes and make one task of them.
    """
    return files.repartition(max(1, -(-files.count() // per_task)))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def salt_of(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def look_up(
    rows: DataFrame, key: str, spread: Column, found: DataFrame, how: str = "inner", salts: int = 128
) -> DataFrame:
    """Join ``found`` (one row per ``key``) to ``rows``, where one key may hold most rows.

    A row's salt comes from ``spread``, a column that differs between rows of a key. Each row of
    ``found`` is repeated once for every salt that its key has, never more often than the key has
    rows, so that the rows of a hot key are joined in up to ``salts`` tasks.
    """
    salted = rows.withColumn("__salt", salt_of(spread, salts))
    present = (
        salted.groupBy(key, "__salt")
        .agg(F.lit(1).alias("__one"))
        .groupBy(key)
        .agg(F.collect_list("__salt").alias("__salts"))
    )
    repeated = found.join(present, key).withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")


def add_columns(
    df: DataFrame,
    added: dict[str, str],
    work: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    text: str = "text",
) -> DataFrame:
    """``df`` with columns computed from its texts by ``work()``, which is made once per task and
    gets the texts of a batch as UTF-8 (null as empty). Columns of those names are replaced."""
    kept = df.drop(*added)
    at = kept.columns.index(text)
    kinds = ", ".join(f"{name} {kind}" for name, kind in added.items())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in slices(batches):
            one = one or work()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *one(texts_of(batch.column(at)))],
                names=[*batch.schema.names, *added],
            )

    more = kept.sparkSession.createDataFrame([], kinds).schema
    return kept.mapInArrow(task, StructType([*kept.schema, *more]))


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of these names renamed, and the columns that bring them back."""
    own = {c: f"__own_{c}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns]


def sum_arrays(parts: DataFrame, at_once: int = 64, dtype: str = "<i8") -> DataFrame:
    """Add up ``values`` (whole numbers of ``dtype``, as binary) per ``key``.

    ``parts`` has part (from 0), key, values. Each round adds up to ``at_once`` neighbouring parts
    of a key, so no task ever holds more than one array and a batch of them.
    """
    kind = parts.schema["key"].dataType.simpleString()
    schema = f"part long, key {kind}, values binary"
    count = max(1, parts.rdd.getNumPartitions())

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("values"):
                own = np.frombuffer(data.as_buffer(), dtype)
                total = own.copy() if total is None else np.add(total, own, out=total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(key[0].as_py())], pa.int64()),
                pa.array([key[1].as_py()], key[1].type),
                pa.array([total.tobytes()], pa.binary()),
            ],
            names=["part", "key", "values"],
        )

    while True:
        count = -(-count // at_once)
        parts = (
            parts.withColumn("part", F.floor(F.col("part") / at_once) if count > 1 else F.lit(0))
            .groupBy("part", "key")
            .applyInArrow(added, schema)
        )
        if count == 1:
            return parts.select("key", "values")


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 16  # bytes of a text that are hashed at once, to the end of the run there
_powers = _inverses = np.empty(0, np.uint64)


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** (i + 1) and base ** -i of each i below ``n``, or more of them, modulo 2 ** 64."""
    global _powers, _inverses
    if len(_powers) < n:
        some = max(_BLOCK, 2 * n)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(some, np.uint64(_BASE)), dtype=np.uint64)
            _inverses = np.full(some, np.uint64(pow(_BASE, -1, 1 << 64)))
            _inverses[0] = 1
            _inverses = np.cumprod(_inverses, dtype=np.uint64)
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(text: bytes, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and kind of each longest run of bytes of one kind; kind 0 is left out."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    kind = np.frombuffer(text.translate(kinds.tobytes()), np.uint8)
    borders = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]))
    kept = np.flatnonzero(kind[borders[:-1]])
    starts, ends = borders[kept], borders[kept + 1]
    sums = (ends - starts).astype(np.uint64) * _FACTOR
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(int(np.searchsorted(starts, begin + _BLOCK)), first + 1)
        end = ends[last - 1]
        powers, inverses = _powers_up_to(int(end - begin))
        total = np.zeros(end - begin + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data[begin:end] + np.uint64(1)) * powers[: end - begin], out=total[1:])
            own = starts[first:last] - begin
            sums[first:last] += (total[ends[first:last] - begin] - total[own]) * inverses[own]
        first = last
    return mixed(sums), kind[starts]


#: For run_hashes: words are what stands between white space.
BETWEEN_SPACE = np.ones(256, np.uint8)
BETWEEN_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: Words (digits, ASCII letters, bytes of other characters) are 1, runs of signs are 2.
WORDS_AND_SIGNS = np.full(256, 2, np.uint8)
WORDS_AND_SIGNS[[*range(0x21), 0x7F]] = 0
WORDS_AND_SIGNS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
WORDS_AND_SIGNS[0x80:] = 1


def crc_rest(column: Column, by: int) -> Column:
    """``crc32(column as text) mod by``; -1 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % by, F.lit(-1))
