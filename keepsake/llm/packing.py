"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space best fit: a task holds a fixed number of open sequences, whose free places key a
bit set. A piece goes to the open sequence with the least free places that still holds it; if none
does, a sequence is opened, and when too many are open the fullest is closed. Nothing of an open
sequence is held but its number and its length, as each piece leaves with its place at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import slices
from keepsake.llm.encoding import encoder as encoder_of


class BestFit:
    """``place(n)`` gives the sequence and the offset of a piece of ``n`` tokens."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.opened = 0
        self._free = 0  # bit f: some open sequence has f free places
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._open = 0

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        number = bins.pop()
        if not bins:
            self._free &= ~(1 << free)
        self._open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self._free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.opened, self.capacity
            self.opened += 1
            if size < free and self._open >= self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)  # closes the fullest
        left = free - size
        if left:
            self._by_free[left].append(number)
            self._free |= 1 << left
            self._open += 1
        return number, self.capacity - free


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    open_bins: int = 1024,
    ahead_tokens: int = 4_000_000,
) -> DataFrame:
    """Cut the tokens of ``docs`` (doc_id, text) into pieces and place them in sequences.

    A document is its token ids and ``end_id``; null text is empty, so each row gives at least one
    piece, repeated rows and null ids included. Only documents over ``capacity`` are cut: the first
    piece takes what is over, all others are full. Pieces wait until ``ahead_tokens`` of them have
    come and are then placed from long to short, which leaves little free space; the open
    sequences go on to the next lot. Other columns are ignored; an empty table gives no rows.

    Returns doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.
    There is no shuffle: each task packs what it reads, and the numbers of its sequences begin
    with the number of its partition, so a repeated task gives the same rows.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = None, BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 33
        end = int(end_id).to_bytes(4, "little")
        waiting: list[tuple] = []
        waits = 0

        def placed(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            pieces.sort(key=lambda p: -len(p[3]))
            for at in range(0, len(pieces), 2048):
                some = pieces[at : at + 2048]
                spots = [bins.place(len(p[3]) // 4) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in some], id_type),
                        pa.array([p[1] for p in some], pa.int32()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([len(p[3]) // 4 for p in some], pa.int64()),
                        pa.array([p[3] for p in some], pa.binary()),
                        pa.array([base + n for n, _ in spots], pa.int64()),
                        pa.array([o for _, o in spots], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

        for batch in slices(batches):
            encoder = encoder or encoder_of(tokenizer)
            id_type = batch.column(0).type
            encoded = encoder.encode(batch.column(1).fill_null(""))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                n = len(ids) // 4
                cut, piece, start = n % capacity or min(n, capacity), 0, 0
                while start < n:
                    waiting.append((doc_id, piece, start, ids[4 * start : 4 * (start + cut)]))
                    piece, start, cut = piece + 1, start + cut, capacity
                waits += n
            if waits >= ahead_tokens:
                yield from placed(waiting)
                waiting, waits = [], 0
        if waiting:
            yield from placed(waiting)
            del waiting
            pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return docs.mapInArrow(
        task,
        f"doc_id {kind}, piece int, start long, length long, ids binary,"
        " sequence_id long, offset long",
    )
