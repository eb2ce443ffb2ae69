"""Benchmark decontamination: windows of test words, looked up in a broadcast hash set.

Words are runs of digits, ASCII letters in lower case and non-ASCII characters. A window is so
many consecutive words of a test item; an item with fewer words, but not none, is one window.
Only words of the test items get numbers, so a training window with any other word in it is passed
over; the others are looked up by hash, and what is found is compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import set_aside, slices, texts_of
from keepsake.session import stage, stage_table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ADDED = ["n_words", "n_hit", "items", "spans", "contaminated"]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes.lower changes A-Z alone


class Windows:
    """The windows of some test items, by length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        self.numbers: dict[bytes, int] = {}
        #: numbers of the words of a window -> the items that hold it
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            n = min(size, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                self.items.setdefault(tuple(own[at : at + n]), set()).add(item)
        self.hashes: dict[int, np.ndarray] = {}
        for n in {len(w) for w in self.items}:
            some = np.array([w for w in self.items if len(w) == n], np.uint64)
            self.hashes[n] = np.unique(hashes(some.ravel(), n)[::n])

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words of a document are inside a window, and the items of those windows."""
        get = self.numbers.get
        own = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        hit = np.zeros(len(own), bool)
        found: set[str] = set()
        for n, known in self.hashes.items():
            if len(own) < n:
                continue
            unknown = np.concatenate(([0], np.cumsum(own == 0)))
            spots = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(spots):
                continue
            seen = hashes(own, n)[spots]
            at = np.minimum(np.searchsorted(known, seen), len(known) - 1)
            for spot in spots[known[at] == seen].tolist():
                items = self.items.get(tuple(own[spot : spot + n].tolist()))
                if items:
                    hit[spot : spot + n] = True
                    found |= items
        return hit, found


def hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive numbers."""
    count = len(numbers) - n + 1
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ numbers[k : k + count]) * _FACTOR
            out ^= out >> np.uint64(29)
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, read from Spark one after another, in lists of about ``block_bytes`` of text."""
    held: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator(prefetchPartitions=True):
        data = (text or "").encode()
        if held and size + len(data) > block_bytes:
            yield held
            held, size = [], 0
        held.append(("" if item is None else item, data))
        size += len(data)
    if held:
        yield held


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    block_bytes: int = 32 << 20,
    report: int = 20,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` and ``spans`` to every row of ``docs``.

    ``items`` are the ids of test items (benchmark: item_id, text) with windows in the text, sorted
    as strings; ``spans`` the hit words as array of (first, end); ``contaminated`` is set if any
    word is hit and hit words times ``report`` are at least the words. Null and empty texts have no
    words, a null item_id is the empty string, an empty benchmark hits nothing. Columns of ``docs``
    with one of these names are replaced. Each block of test text (``block_bytes`` at most, or one
    item) is broadcast on its own. Of several blocks each one's hits go to the shared folder, and its
    broadcast is released, before a third or later block is read.
    """
    kept = docs.drop(*_ADDED)
    empty = {
        "n_words": F.lit(0).cast("long"),
        "n_hit": F.lit(0).cast("long"),
        "items": F.array().cast("array<string>"),
        "spans": F.array().cast("array<int>"),
    }
    context = docs.sparkSession.sparkContext
    blocks = blocks_of(benchmark, block_bytes)
    only, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = kept.withColumns(empty)
    else:
        row = "__row"
        while row in kept.columns:
            row += "_"
        numbered = stage(kept.withColumn(row, F.monotonically_increasing_id()))
        bare = numbered.select(row, "text").withColumns(empty)
        found = None
        for block in chain([only, second], blocks):
            shared = context.broadcast((block, size))
            hits = bare.mapInArrow(_scanner(shared, 1, 2), bare.schema)
            hits = hits.filter(F.size("spans") > 0).select(row, "items", "spans")
            hits = stage_table(hits, "hits")
            shared.destroy()
            found = hits if found is None else found.union(hits)
        merged = found.groupBy(row).agg(
            F.flatten(F.collect_list("items")).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"),
        )
        out = numbered.join(merged, row, "left").select(
            *[F.col(f"`{c}`") for c in kept.columns],
            empty["n_words"].alias("n_words"),
            empty["n_hit"].alias("n_hit"),
            F.coalesce("items", empty["items"]).alias("items"),
            F.coalesce("spans", empty["spans"]).alias("spans"),
        )
        only = []  # the last pass only joins the hits
    shared = context.broadcast((only, size))
    at, text_at = len(kept.columns), kept.columns.index("text")
    out = out.mapInArrow(_scanner(shared, text_at, at), kept.withColumns(empty).schema)
    pairs = "transform(sequence(0, cast(size(spans) / 2 as int) - 1), i -> struct(spans[2*i] as first, spans[2*i+1] as end))"
    return out.withColumns(
        {
            "spans": F.expr(
                f"if(size(spans) = 0, cast(array() as array<struct<first:int,end:int>>), {pairs})"
            ),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * report >= F.col("n_words")),
        }
    )


def _scanner(shared: Broadcast, text_at: int, at: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for batch in slices(batches):
            windows = windows or Windows(*shared.value)
            n_words, n_hit, items, spans = [], [], [], []
            earlier = [batch.column(at + k).to_pylist() for k in (2, 3)]
            for text, known, marks in zip(texts_of(batch.column(text_at)), *earlier):
                words = words_of(text)
                hit, found = windows.find(words)
                for first, end in zip(marks[::2], marks[1::2]):
                    hit[first:end] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                items.append(sorted(found.union(known)))
                spans.append(edges.astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:at],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.int32())),
                ],
                names=batch.schema.names,
            )

    return task


def without_documents(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """``docs`` without the contaminated ones; columns of any name are kept as they are."""
    own, back = set_aside(docs, _ADDED)
    return scan(own, benchmark, **how).filter(~F.col("contaminated")).select(back)


def without_spans(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``, from the first word of a span to its last;
    what is left on both sides is kept as it is. Null stays null."""
    own, back = set_aside(docs, _ADDED)
    scanned = scan(own, benchmark, **how)
    names, text_at = docs.columns, docs.columns.index("text")
    flat = F.expr("flatten(transform(spans, s -> array(s.first, s.end)))")
    wanted = scanned.select(*back, flat.alias("__marks"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            for k, marks in enumerate(batch.column(len(names)).to_pylist()):
                if marks:
                    spots = [m.span() for m in _WORD.finditer(texts[k].lower())]
                    parts, done = [], 0
                    for first, end in zip(marks[::2], marks[1::2]):
                        parts.append(texts[k][done : spots[first][0]])
                        done = spots[end - 1][1]
                    texts[k] = b"".join([*parts, texts[k][done:]])
            columns = list(batch.columns[: len(names)])
            columns[text_at] = pa.array(texts, pa.binary()).cast(columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    return wanted.mapInArrow(task, docs.schema)
