"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

A task sorts a block of candidates once per dimension. For a query each list is read from the end
where the query's component adds most. The lists are read a few entries further at a time; new
candidates are scored in full. No unseen candidate can score more than the sum of what the lists'
next entries would add, and reading stops as soon as that bound is below the k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import new_folder
from keepsake.sources.storage import entries, open_read


class Block:
    """Candidates of one dimension count, with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order]
        self.dims = whole.shape[1]
        self.top = int(np.abs(whole).max(initial=0))
        self.vectors = whole
        self.exact = whole.astype(np.float64) if self.top < 1 << 26 else whole
        # Row d of ``order`` has, for each dimension, the candidate with the d-th smallest value.
        self.order = np.argsort(whole, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(whole, self.order.astype(np.int64), axis=0)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, ties to smaller ids, and how many were scored."""
        n = len(self.ids)
        most = self.top * int(np.abs(query).sum())
        exact = most < 1 << 53 and self.exact is not self.vectors
        data = self.exact if exact else self.vectors
        q = query.astype(np.float64) if exact else query
        used = np.flatnonzero(query)
        down = query > 0
        seen = np.zeros(n, bool)
        seen[self.ids == query_id] = True
        got_ids, got = np.empty(0, np.int64), np.empty(0, np.int64)
        scored, done, depth = 0, 0, min(16, n)
        while True:
            new = np.zeros(n, bool)
            if len(used):
                rows = np.arange(done, depth)[:, None]
                new[self.order[np.where(down[used], n - 1 - rows, rows), used]] = True
            else:
                new[:] = True
                depth = n
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            scored += len(at)
            score = (data[at] @ q).astype(np.int64)
            got_ids, got = np.concatenate((got_ids, self.ids[at])), np.concatenate((got, score))
            best = np.lexsort((got_ids, -got))[:k]
            got_ids, got = got_ids[best], got[best]
            if depth >= n:
                break
            last = self.sorted[np.where(down, n - depth, depth - 1), np.arange(self.dims)]
            bound = int(last.astype(np.int64) @ query)  # of what is still unseen
            if len(got) == k and int(got[-1]) > bound:
                break
            done, depth = depth, min(n, depth * 4)
        return got_ids, got, scored


def quantised(column: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    return F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(column: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(
        column,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.coalesce(column.isNotNull() & ~bad, F.lit(False))


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 16384
) -> DataFrame:
    """The ``k`` candidates with the greatest inner product for every query.

    Both have vec_id (long) and vector (array of whole numbers). A candidate with the query's own
    id is not compared with it, nor are vectors of different lengths; ties go to the smaller id.
    Rows with a null id or vector take no part. Queries are written to the shared folder; a task
    holds one block of candidates and reads the queries in batches, so neither side is ever held
    whole, and each block gives at most ``k`` rows per query.

    Returns query_id, rank (from 1), vec_id, score, scored (candidates of the best one's block that
    were scored in full).
    """
    spark = candidates.sparkSession
    folder = new_folder(spark, "queries")
    there = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    pick = (F.col("vec_id").cast("long"), F.col("vector").cast("array<bigint>"))
    queries.filter(there).select(*pick).write.parquet(folder)

    def pieces() -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        import pyarrow.parquet as pq

        names = [n for n, kind, *_ in entries(folder) if kind == "file" and n.endswith(".parquet")]
        for name in sorted(names):
            with open_read(f"{folder}/{name}") as f:
                for batch in pq.ParquetFile(pa.PythonFile(f, "r")).iter_batches(4096):
                    yield _columns(batch)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(_columns(batch.slice(at, block_rows)))
                rows += len(held[-1][0])
                if rows >= block_rows:
                    yield from answered(held)
                    held, rows = [], 0
        if rows:
            yield from answered(held)

    def answered(held: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h[0] for h in held])
        vectors = [v for h in held for v in h[1]]
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        blocks = {n: Block(ids[own], np.stack([vectors[i] for i in own])) for n, own in by_size.items()}
        for query_ids, found in pieces():
            out: list[list[np.ndarray]] = [[], [], [], []]
            for query_id, query in zip(query_ids.tolist(), found):
                if len(query) in blocks:
                    best, score, scored = blocks[len(query)].best(query_id, query, k)
                    same = np.full(len(best), query_id), best, score, np.full(len(best), scored)
                    for have, more in zip(out, same):
                        have.append(more)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in out],
                    names=["query_id", "vec_id", "score", "scored"],
                )

    local = (
        candidates.filter(there)
        .select(*pick)
        .mapInArrow(task, "query_id long, vec_id long, score long, scored long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "scored")
    )


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors of a batch without copying each vector apart."""
    vectors = batch.column(1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    offsets = offsets - offsets[0]
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return ids, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
