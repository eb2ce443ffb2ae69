"""What each filter of a chain removes, in every order: an incremental stream with retraction.

The files of a table arrive as micro-batches. A filter that looks at one text alone is decided
where the text is read. The duplicate filter is not: a text fails it as soon as any row with a
smaller id has the same text, and that row may come in a later batch. So every row is first counted
as a duplicate; the stream's state holds, for each text, the smallest id so far and the rows that
have it, and those rows' counts are moved to "no duplicate". When a smaller id arrives, the earlier
ones are moved back: the counters get what was stated before with a minus.

The state is keyed by buckets of texts, not by the text: a call to the state store costs as much as
many texts, so a batch reads and writes each bucket once.

Counters are kept per part (the row's source), set of failed filters and labels. There are few of
them, and all figures of all orders are sums of them.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from keepsake.llm.common import slices, texts_of
from keepsake.session import new_folder

FILTERS = "ABCDE"
_A, _B, _C, _D, _E = (1 << i for i in range(5))
_UPPER = bytes(range(0x41, 0x5B))
_SIGNS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a character that do not begin it
#: Texts, or counters, that a task combines before it hands them on.
_COMBINED = 100_000
_NO_ID_SALTS = 4096
#: Keys of the state; a task holds the texts of one of them at a time.
_BUCKETS = 4096
_KEY_BYTES = 32  # of a text's SHA-256

_COUNTER = "part string, mask int, good int, toxic int, n long"


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails.

    A: under 50 words; B: under 65 percent of the words distinct; C: over 5 percent of the
    characters capital A to Z; D: one of # $ % & * |. Words stand between ASCII white space.
    """
    words = text.split()  # of bytes: at blank, tab, line feed, vertical tab, form feed, return
    capitals = len(text) - len(text.translate(None, _UPPER))
    characters = len(text.translate(None, _CONTINUED))
    return (
        _A * (len(words) < 50)
        | _B * (100 * len(set(words)) < 65 * len(words))
        | _C * (100 * capitals > 5 * characters)
        | _D * (len(text) != len(text.translate(None, _SIGNS)))
    )


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, salt, key, part, mask) of every row; the text goes no further than this.

    Rows without an id get a salt, so that they spread when labels are looked up by it.
    """
    id_field = StructField("doc_id", docs.schema["doc_id"].dataType)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            salts = []
            for known in batch.column(0).is_valid().to_pylist():
                row += 1
                salts.append(0 if known else 1 + row % _NO_ID_SALTS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(salts, pa.int32()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    batch.column(2),
                    pa.array([text_failures(t) for t in texts], pa.int32()),
                ],
                names=["doc_id", "salt", "key", "part", "mask"],
            )

    rest = docs.sparkSession.createDataFrame([], "salt int, key binary, part string, mask int")
    own = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
    )
    return own.mapInArrow(task, StructType([id_field, *rest.schema]))


def _combined(rows: DataFrame, buckets: int) -> DataFrame:
    """Counters of each task's rows, and of each text its rows with the smallest id.

    A counter has no id and a short key of its own; rows without an id are only counted. What is
    handed on of a text does not grow with its copies but with the tasks that met it. A key's
    first bytes say which of the ``buckets`` it is in.
    """
    id_type = rows.schema["doc_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple, int] = {}
        texts: dict[bytes, list] = {}
        arrow_type = None

        def out() -> pa.RecordBatch:
            found = [
                (hashlib.sha256(repr(c).encode()).digest()[:8], None, *c, n)
                for c, n in counters.items()
            ]
            for key, (doc_id, mask, own) in texts.items():
                found += [(key, doc_id, part, mask, good, toxic, n)
                          for (part, good, toxic), n in own.items()]
            kinds = [pa.binary(), arrow_type, pa.string(), *[pa.int32()] * 3, pa.int64()]
            bucket = [int.from_bytes(key[:8], "big") % buckets for key, *_ in found]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()),
                 *(pa.array(c, k) for c, k in zip(zip(*found), kinds))],
                names=["bucket", "key", "doc_id", "part", "mask", "good", "toxic", "n"],
            )

        for batch in batches:
            arrow_type = batch.column(0).type
            for doc_id, key, part, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id is not None:
                    least = texts.get(key)
                    if least is None or doc_id < least[0]:
                        texts[key] = [doc_id, mask, {(part, good, toxic): 1}]
                    elif doc_id == least[0]:
                        own = least[2]
                        own[part, good, toxic] = own.get((part, good, toxic), 0) + 1
                    mask |= _E
                counter = part, mask, good, toxic
                counters[counter] = counters.get(counter, 0) + 1
            if len(texts) + len(counters) > _COMBINED:
                yield out()
                counters, texts = {}, {}
        if counters:
            yield out()

    schema = StructType(
        [
            StructField("bucket", IntegerType()),
            StructField("key", rows.schema["key"].dataType),
            StructField("doc_id", id_type),
            *rows.sparkSession.createDataFrame([], _COUNTER).schema,
        ]
    )
    return rows.mapInArrow(task, schema)


_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
#: State of many small partitions: only what a batch changed is written, no disk is reserved, and
#: all partitions of an executor share one bound of memory (MB).
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    f"{_ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{_ROCKSDB}.allowFAllocate": "false",
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
    f"{_ROCKSDB}.maxMemoryUsageMB": "256",
    f"{_ROCKSDB}.writeBufferSizeMB": "1",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for a query that is started inside; it keeps them, the session does not."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class SmallestIds(StatefulProcessor):
    """Per text: the smallest id so far and its rows. Gives changes of the counters.

    A key is a bucket of texts. Its state is a list with one entry for each batch that changed
    something: the keys of the changed texts, their smallest ids and those ids' rows. Of a text in
    several entries the last one holds.
    """

    def __init__(self, id_type: DataType) -> None:
        self._schema = StructType(
            [
                StructField("keys", BinaryType()),
                StructField("ids", ArrayType(id_type)),
                StructField("rows", StringType()),
            ]
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._least = handle.getListState("least", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        changes: Counter = Counter()
        texts: dict[bytes, list] = {}
        for row in rows:
            kind = row.part, row.good, row.toxic
            if row.doc_id is None:
                changes[row.part, row.mask, row.good, row.toxic] += row.n
                continue
            least = texts.get(row.key)
            if least is None or row.doc_id < least[0]:
                texts[row.key] = [row.doc_id, row.mask, {kind: row.n}]
            elif row.doc_id == least[0]:
                least[2][kind] = least[2].get(kind, 0) + row.n
        if texts:
            before = self._before(texts)
            changed = []
            for text, (least, mask, own) in texts.items():
                earlier_id, earlier = before.get(text, (None, {}))
                if earlier_id is not None and earlier_id < least:
                    continue
                self._move(changes, own, mask | _E, mask)
                if earlier_id == least:
                    for kind, n in earlier.items():
                        own[kind] = own.get(kind, 0) + n
                else:
                    self._move(changes, earlier, mask, mask | _E)
                changed.append((text, least, [[*kind, n] for kind, n in own.items()]))
            if changed:
                keys, ids, own_rows = zip(*changed)
                self._least.appendValue((b"".join(keys), list(ids), json.dumps(own_rows)))
        for (part, mask, good, toxic), n in changes.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def _before(self, texts: dict[bytes, list]) -> dict[bytes, tuple]:
        """Smallest id and its rows of those of ``texts`` that came in earlier batches."""
        found = {}
        for keys, ids, rows in self._least.get():
            keys = bytes(keys)
            own_rows = json.loads(rows)
            for i, doc_id in enumerate(ids):
                text = keys[i * _KEY_BYTES : (i + 1) * _KEY_BYTES]
                if text in texts:
                    found[text] = doc_id, {(p, g, t): n for p, g, t, n in own_rows[i]}
        return found

    @staticmethod
    def _move(changes: Counter, own: dict, source: int, target: int) -> None:
        for (part, good, toxic), n in own.items():
            changes[part, source, good, toxic] -= n
            changes[part, target, good, toxic] += n

    def close(self) -> None:
        pass


def count_stream(
    docs: DataFrame,
    labels: DataFrame,
    counters: str,
    checkpoint: str,
    seconds: int = 24 * 3600,
    buckets: int = _BUCKETS,
) -> DataFrame:
    """Run the stream ``docs`` (doc_id, text, source) to the end of what is there.

    ``labels`` (doc_id, quality, toxic) is a table; a row is good, or toxic, if any label of its
    id says so with 1. Each micro-batch writes the changes it makes to ``counters`` under its own
    number, so a repeated one replaces them. Started again with the same folders and ``buckets``,
    the stream takes only files that are new. A micro-batch reads the state of every bucket that it
    has a text of, so a few large ones are cheaper than many small ones. Returns part, mask (bits
    of the failed filters, A lowest), good, toxic, n.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
        .select("doc_id", F.lit(0).alias("salt"), "good", "toxic")
    )
    none = F.lit(0)
    labelled = (
        _read(docs)
        .join(known, ["doc_id", "salt"], "left")
        .select(
            "doc_id", "key", "part", "mask",
            F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"),
        )
    )
    combined = _combined(labelled, buckets)
    schema = spark.createDataFrame([], _COUNTER).schema
    changes = combined.groupBy("bucket").transformWithState(
        statefulProcessor=SmallestIds(combined.schema["doc_id"].dataType),
        outputStructType=schema,
        outputMode="Update",
        timeMode="None",
    )
    by = ["part", "mask", "good", "toxic"]

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy(*by).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
        summed.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    with _settings(spark, _STATE_STORE):
        query = (
            changes.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not finish")
    # Without a file there is no batch; the schema with the folders' number keeps that readable.
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], schema)
    written = spark.read.schema(schema).parquet(f"{counters}/batch=*")
    return written.groupBy(*by).agg(F.sum("n").cast("long").alias("n")).filter(F.col("n") != 0)


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of those before it) of every order."""
    rows = []
    for order in itertools.permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return rows


def figures(counters: DataFrame) -> DataFrame:
    """The figures of every part, order and step from ``counters`` (:func:`count_stream`).

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; one row for each part and step of each order, zeros included. No counter,
    no row. A step's figures depend on its filter and on which others came before, not on their
    order: they are summed for these few cases first.
    """
    spark = counters.sparkSession
    steps = orders()
    cases = sorted({(bit, before) for _, _, bit, before in steps})
    case = F.explode(
        F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(x).alias("before")) for b, x in cases])
    )
    mask, bit, before = F.col("mask"), F.col("case.bit"), F.col("case.before")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    removed = fails & ~gone
    # Of the orders, each failed filter of a row comes first in an equal share.
    first_in = F.element_at(
        F.array(*[F.lit(len(steps) // 5 // max(m.bit_count(), 1)) for m in range(32)]), mask + 1
    )
    n = F.col("n")

    def total(when) -> object:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    summed = (
        counters.withColumn("case", case)
        .groupBy("part", "case.bit", "case.before")
        .agg(
            total(~fails & ~gone).alias("kept"),
            total(removed).alias("removed"),
            total(fails & gone).alias("redundant"),
            total(mask == bit).alias("unique_fails"),
            total(removed & (F.col("good") == 1)).alias("good_lost"),
            total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
            F.coalesce(F.sum(F.when(fails, n * first_in)), F.lit(0)).cast("long").alias("shapley"),
        )
    )
    every = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return summed.join(F.broadcast(every), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    )


def audit(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, files_at_once: int | None = None
) -> DataFrame:
    """Audit the filters over the parquet table at ``path`` (doc_id, text, source, any others).

    All files are taken, as at most ``batches`` micro-batches or ``files_at_once`` files each.

    Null text counts as empty, null source as the part "". A row without an id is no duplicate and
    makes none; rows of one id are no duplicates of each other. Repeated rows are counted each;
    what an id is labelled with counts for all its rows. An empty table gives no rows. See
    :func:`figures` for what comes back.
    """
    given = spark.read.parquet(path)
    if files_at_once is None:
        files_at_once = max(1, -(-len(given.inputFiles()) // batches))
    # A stream reads a folder, or what a pattern finds, which may be one file.
    above, _, name = path.rstrip("/").rpartition("/")
    docs = (
        spark.readStream.schema(given.schema)
        .option("maxFilesPerTrigger", files_at_once)
        .parquet(f"{above}/[{name[0]}]{name[1:]}")
    )
    folder = new_folder(spark, "filter-audit")
    return figures(count_stream(docs, labels, f"{folder}/counters", f"{folder}/stream"))
