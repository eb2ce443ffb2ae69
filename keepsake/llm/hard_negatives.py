"""Hard negatives: for each anchor and positive, the best rows of other labels within a window.

A window reaches from a share of the positive's score up to another share of it. The windows of one
anchor overlap. Their upper limits cut the scores into slots that do not: a window takes its own
slot and all below, down to its lower limit. So it is enough to know the best few rows of every
slot. They are taken per block of rows, then over all blocks, and merged from the lowest slot up:
what is merged so far answers the window whose slot came last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import new_folder, stage_table
from keepsake.sources.storage import entries, open_read

_SCORES_AT_ONCE = 1 << 22
_NEVER = np.iinfo(np.int64).min

_PAIRS = "anchor_id long, vec_id long, score long"
_SLOTS = "anchor_id long, slot int, vec_id long, score long"
_MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long,"
    " negative_score long"
)


class Rows:
    """Vectors of one length with their ids and labels, in the order of the ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.top = int(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)

    def take(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.vectors[at])

    def scores(self, anchors: Rows) -> np.ndarray:
        """Inner products, anchors by rows. Doubles hold them exactly up to 2 ** 53."""
        dims = self.vectors.shape[1]
        if self.top * anchors.top * max(dims, 1) < 1 << 53:
            return (anchors.floats @ self.floats.T).astype(np.int64)
        return anchors.vectors @ self.vectors.T


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest entries of each row, ties to smaller columns; entries
    of ``_NEVER`` take no part."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    else:
        kth = np.full((len(scores), 1), _NEVER)
    at, column = np.nonzero((scores >= kth) & (scores > _NEVER))
    order = np.lexsort((column, -scores[at, column], at))
    at, column = at[order], column[order]
    starts = np.searchsorted(at, np.arange(len(scores)))
    kept = np.arange(len(at)) - starts[at] < k
    return at[kept], column[kept]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, tuple[Rows, list]]:
    """Rows of (vec_id, label, vector, any more) by the vectors' length, and what more each has."""
    ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
    labels = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
    vectors = [v for b in batches for v in _lists(b.column(2))]
    more = [x for b in batches for x in (_lists(b.column(3)) if b.num_columns > 3 else [None] * len(b))]
    lengths = np.array([len(v) for v in vectors], int)
    found = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(ids[at], kind="stable")]
        rows = Rows(ids[at], labels[at], np.stack([vectors[i] for i in at]).astype(np.int64))
        found[n] = rows, [more[i] for i in at]
    return found


def _stored(folder: str, rows: int = 4096) -> Iterator[dict[int, tuple[Rows, list]]]:
    """The anchors in the shared folder, a lot at a time."""
    import pyarrow.parquet as pq

    names = [n for n, kind, *_ in entries(folder) if kind == "file" and n.endswith(".parquet")]
    for name in sorted(names):
        with open_read(f"{folder}/{name}") as f:
            for batch in pq.ParquetFile(pa.PythonFile(f, "r")).iter_batches(rows):
                yield _by_length([batch])


def _against_blocks(
    candidates: DataFrame, folder: str, work, schema: str, block_rows: int
) -> DataFrame:
    """``work(rows, anchors, more)`` for every block of candidates and lot of anchors."""
    names = [c.split()[0] for c in schema.split(", ")]

    def answered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _by_length(held)
        for lot in _stored(folder):
            for n, (anchors, more) in lot.items():
                if n not in blocks:
                    continue
                rows = blocks[n][0]
                step = max(1, _SCORES_AT_ONCE // len(rows.ids))
                for at in range(0, len(anchors.ids), step):
                    some = slice(at, at + step)
                    out = work(rows, anchors.take(some), more[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x, pa.int32() if name == "slot" else pa.int64())
                            for name, x in zip(names, out)
                        ],
                        names=names,
                    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                rows += held[-1].num_rows
                if rows >= block_rows:
                    yield from answered(held)
                    held, rows = [], 0
        if rows:
            yield from answered(held)

    return candidates.mapInArrow(task, schema)


def _positives_of(k: int):
    def work(rows: Rows, anchors: Rows, _: list) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[], [], []]
        for label in np.unique(anchors.labels).tolist():
            own = anchors.take(anchors.labels == label)
            same = rows.take(rows.labels == label)
            if not len(same.ids):
                continue
            scores = same.scores(own)
            scores[same.ids[None, :] == own.ids[:, None]] = _NEVER
            at, column = best_of(scores, k)
            for have, more in zip(found, (own.ids[at], same.ids[column], scores[at, column])):
                have.append(more)
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]

    return work


def _slots_of(k: int):
    def work(rows: Rows, anchors: Rows, limits: list[np.ndarray]) -> list[np.ndarray]:
        scores = rows.scores(anchors)
        scores[rows.labels[None, :] == anchors.labels[:, None]] = _NEVER
        most = max(map(len, limits)) - 1
        # The last limit is the lowest score that any window takes, less one.
        edges = np.stack([np.pad(x, (0, most + 1 - len(x)), mode="edge") for x in limits])
        found: list[list[np.ndarray]] = [[], [], [], []]
        for slot in range(most):
            inside = (scores <= edges[:, slot, None]) & (scores > edges[:, slot + 1, None])
            at, column = best_of(np.where(inside, scores, _NEVER), k)
            new = anchors.ids[at], np.full(len(at), slot), rows.ids[column], scores[at, column]
            for have, more in zip(found, new):
                have.append(more)
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]

    return work


def merged_windows(
    positives: list[dict], tops: list[dict], edges: list[int], k: int, low: int
) -> list[tuple]:
    """(positive_id, rank, negative_id, positive_score, negative_score) of one anchor.

    ``positives`` have vec_id, score, limit (the window's upper limit); ``edges`` are the distinct
    limits from high to low; ``tops`` (slot, vec_id, score) are the best rows of each slot.
    """
    slots: list[list[tuple[int, int]]] = [[] for _ in edges]
    for row in tops:
        slots[row["slot"]].append((-row["score"], row["vec_id"]))
    best: list[tuple[int, int]] = []
    answers = {}
    for slot in range(len(edges) - 1, -1, -1):
        best = sorted(best + slots[slot])[:k]
        answers[edges[slot]] = best
    return [
        (p["vec_id"], rank, vec_id, p["score"], -score)
        for p in positives
        for rank, (score, vec_id) in enumerate(
            (x for x in answers[p["limit"]] if low * p["score"] <= -100 * x[0]), 1
        )
    ]


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _percent(score: Column, percent: int) -> Column:
    """``floor(percent * score / 100)``, in whole numbers."""
    part = F.lit(percent).cast("long") * score
    return F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100))


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_rows: int = 32768,
) -> DataFrame:
    """Hard negatives from ``rows`` (vec_id long, label, vector: array of whole numbers).

    Anchors are the rows for which the condition ``anchor`` holds. An anchor's positives are the
    ``positives`` rows of its label with the greatest inner product, rows with its own id left
    out; for each, the first ``negatives`` rows of other labels are returned whose score lies
    between ``low`` and ``high`` percent of the positive's, both included. Ties go to smaller ids.
    A negative positive score leaves no such score, so nothing is returned for it.

    Rows with a null id, label or vector take no part; other columns are ignored; vectors are
    compared with those of their own length. A repeated row counts as often as it is there; of
    anchors with one id the one with the smallest label and vector is taken. An empty table, or
    one without anchors, gives no rows.

    Anchors lie in the shared folder and are read in lots by every task, which holds one block of
    rows, so neither side is ever held whole. A block gives at most ``positives`` rows, then
    ``negatives`` for each of at most ``positives`` slots, per anchor.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    pick = [F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>")]
    own = rows.filter(there)
    candidates = own.select(*pick)
    chosen = (
        own.filter(anchor)
        .select(*pick)
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("vec_id", "row.*")
    )
    spark = rows.sparkSession
    folder = new_folder(spark, "anchors")
    chosen.write.parquet(folder)
    anchors = spark.read.schema(chosen.schema).parquet(folder)

    near = _against_blocks(candidates, folder, _positives_of(positives), _PAIRS, block_rows)
    limit = _percent(F.col("score"), high)
    floor = _percent(F.col("score"), low)  # at most the lowest score within the window
    found = (
        _first(near, positives, "anchor_id")
        .filter(F.col("score") >= 0)
        .withColumn("limit", limit)
        .groupBy("anchor_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "limit"))).alias("positives"),
            F.reverse(F.array_sort(F.collect_set("limit"))).alias("edges"),
            (F.min(floor) - 1).alias("below"),
        )
    )
    found = stage_table(found, "positives")
    with_limits = anchors.join(found, F.col("anchor_id") == F.col("vec_id")).select(
        "vec_id", "label", "vector", F.concat("edges", F.array("below")).alias("limits")
    )
    folder = new_folder(spark, "anchors-with-limits")
    with_limits.write.parquet(folder)

    tops = _against_blocks(candidates, folder, _slots_of(negatives), _SLOTS, block_rows)
    tops = (
        _first(tops, negatives, "anchor_id", "slot")
        .groupBy("anchor_id")
        .agg(F.collect_list(F.struct("slot", "vec_id", "score")).alias("tops"))
    )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _MINED.split(", ")]
        for batch in batches:
            out = [
                (anchor_id, *answer)
                for anchor_id, given, edges, best in zip(*(c.to_pylist() for c in batch.columns))
                for answer in merged_windows(given, best, edges, negatives, low)
            ]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, columns)],
                names=names,
            )

    return (
        found.join(tops, "anchor_id")
        .select("anchor_id", "positives", "edges", "tops")
        .mapInArrow(answers, _MINED)
    )
