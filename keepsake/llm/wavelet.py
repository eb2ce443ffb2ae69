"""Token files: a wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit planes, the highest bit first. Each plane
lists one bit of every token; zeros of a plane come first in the next one. With the number of ones
before every block of a plane, the token at a place, the number of a token's occurrences before a
place, and the place of its k-th occurrence each take a few steps per plane, without decoding the
rest.

File: 8 bytes of magic, a little-endian 32-bit length, a JSON header of that length, then the
sections it lists (doc ids, lengths, planes), each compressed on its own with Zstandard, or as it is
where that would save next to nothing.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import in_tasks, slices
from keepsake.llm.encoding import encoder as encoder_of
from keepsake.session import new_folder, stage_table
from keepsake.sources.storage import open_read, replacing

MAGIC = b"KSWAVE01"
FILES_PER_TASK = 4  # that a reading task opens one after the other
_PROBE = 1 << 14  # bytes that tell whether a section shrinks
_BLOCK = 512  # bits between two counts of ones


def planes_of(tokens: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit planes from the highest bit down, and the number of zeros of each."""
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bits = (tokens & tokens.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bits))
        zeros.append(int(len(bits) - np.count_nonzero(bits)))
        moved = np.empty_like(tokens)
        np.compress(~bits, tokens, out=moved[: zeros[-1]])
        np.compress(bits, tokens, out=moved[zeros[-1] :])
        tokens = moved
    return planes, zeros


def to_bytes(doc_ids: list, lengths: list[int], tokens: np.ndarray, levels: int) -> bytes:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = planes_of(tokens, levels)
    sections = [json.dumps(doc_ids).encode(), np.asarray(lengths, "<i8").tobytes()]
    packed, raw = [], []
    for section in [*sections, *(p.tobytes() for p in planes)]:
        # Planes of the low bits are as good as random; the first bytes tell.
        some = section[:_PROBE]
        raw.append(len(some) == _PROBE and len(squeeze(some)) > 0.95 * _PROBE)
        packed.append(section if raw[-1] else squeeze(section))
    head = json.dumps(
        {
            "tokens": len(tokens),
            "levels": levels,
            "zeros": zeros,
            "sizes": list(map(len, packed)),
            "raw": raw,
        }
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


class Shard:
    """One file. Sections are decompressed when first needed."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.tokens, self.levels, self.zeros = head["tokens"], head["levels"], head["zeros"]
        self._raw = head["raw"]
        at, self._sections = 12 + size, []
        for n in head["sizes"]:
            self._sections.append(data[at : at + n])
            at += n
        if at != len(data) or len(self._sections) != self.levels + 2:
            raise ValueError("token file cut short")
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _section(self, k: int) -> bytes:
        import zstandard

        if self._raw[k]:
            return self._sections[k]
        return zstandard.ZstdDecompressor().decompress(self._sections[k])

    def documents(self) -> tuple[list, np.ndarray]:
        """Doc ids and lengths, in the order of the tokens."""
        return json.loads(self._section(0)), np.frombuffer(self._section(1), "<i8")

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits, and ones before each block."""
        if k not in self._planes:
            bits = np.frombuffer(self._section(k + 2), np.uint8)
            ones = np.bitwise_count(bits).astype(np.int64)
            per = np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK // 8)) if len(ones) else ones
            self._planes[k] = bits, np.concatenate(([0], np.cumsum(per)))
        return self._planes[k]

    def _bit(self, k: int, at: int) -> int:
        return int(self._plane(k)[0][at >> 3] >> (7 - (at & 7))) & 1

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane ``k`` before place ``at``."""
        bits, before = self._plane(k)
        block = at // _BLOCK
        total = int(before[block]) + int(np.bitwise_count(bits[block * _BLOCK // 8 : at >> 3]).sum())
        return total + (int(bits[at >> 3] >> (8 - (at & 7))).bit_count() if at & 7 else 0)

    def _place_of(self, k: int, bit: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) ``bit`` of plane ``k``."""
        before = self._plane(k)[1]
        counts = before if bit else np.arange(len(before)) * _BLOCK - before
        block = int(np.searchsorted(counts, nth, "right")) - 1
        bits = np.unpackbits(self._plane(k)[0][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8])
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[nth - int(counts[block])])

    def access(self, at: int) -> int:
        """The token at place ``at``."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        token = 0
        for k in range(self.levels):
            bit = self._bit(k, at)
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for k in range(self.levels):
            a, b = self._ones(k, low), self._ones(k, high)
            if token >> (self.levels - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before place ``end`` (all, if not given)."""
        if token < 0 or token >> self.levels:
            return 0
        low, high = self._range(token, self.tokens if end is None else min(end, self.tokens))
        return high - low

    def select(self, token: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) occurrence of ``token``."""
        if not 0 <= nth < self.rank(token):
            raise IndexError(nth)
        at = self._range(token, self.tokens)[0] + nth
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            at = self._place_of(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All tokens: planes are undone from the last to the first."""
        out = np.zeros(self.tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            packed = np.frombuffer(self._section(k + 2), np.uint8)
            bits = np.unpackbits(packed, count=self.tokens).astype(bool)
            before = np.empty_like(out)
            before[~bits] = out[: self.zeros[k]]
            before[bits] = out[self.zeros[k] :] | out.dtype.type(1 << (self.levels - 1 - k))
            out = before
        return out


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    folder: str | None = None,
    shard_tokens: int = 1 << 22,
) -> DataFrame:
    """Write the tokens of ``docs`` (doc_id, text) as shards in ascending order of doc_id.

    A document is its ids and ``end_id`` (null text is empty). Null ids come first, rows of one id
    in the order of their text's hash. A file ends with the document that reaches
    ``shard_tokens``. Rows of one range of ids are written by one task, as whole files that a
    repeated task replaces. Other columns are ignored; no row, no file.

    Returns the files: path, documents, tokens, start (tokens of all files before it). Their
    starts come from one number per range of ids.
    """
    spark = docs.sparkSession
    folder = (folder or new_folder(spark, "tokens")).rstrip("/")
    placed = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("__order", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "__order")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__order")
        .select("doc_id", "text")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        part = TaskContext.get().partitionId()
        doc_ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        total, number, start = 0, 0, 0
        end = int(end_id).to_bytes(4, "little")

        def written() -> pa.RecordBatch:
            levels = max(encoder.top_id, end_id, 1).bit_length()
            tokens = np.frombuffer(b"".join(held), "<u4")
            path = f"{folder}/part-{part:06d}-{number:06d}.ksw"
            with replacing(path) as out:
                out.write(
                    to_bytes(
                        doc_ids,
                        lengths,
                        tokens.astype(np.uint16) if levels <= 16 else tokens,
                        levels,
                    )
                )
            row = [[path], [part], [start], [len(doc_ids)], [total]]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.string()), *(pa.array(x, pa.int64()) for x in row[1:])],
                names=["path", "part", "within", "documents", "tokens"],
            )

        for batch in slices(batches):
            encoder = encoder or encoder_of(tokenizer)
            encoded = encoder.encode(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                held += [ids, end]
                total += lengths[-1]
                if total >= shard_tokens:
                    yield written()
                    number, start = number + 1, start + total
                    doc_ids, lengths, held, total = [], [], [], 0
        if doc_ids:
            yield written()

    files = stage_table(
        placed.mapInArrow(
            task, "path string, part long, within long, documents long, tokens long"
        ),
        "token-files",
    )
    # One row per range of ids, so a handful for the window below.
    bases = (
        files.groupBy("part")
        .agg(F.sum("tokens").alias("all"))
        .withColumn("base", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
        .select("part", "base")
    )
    return files.join(bases, "part").select(
        "path", "documents", "tokens", (F.col("base") + F.col("within")).alias("start")
    )


def read_shards(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The documents of shards: doc_id, start (tokens before it), n_tokens, ids (binary).

    ``files`` are the rows of :func:`write_shards`; a task holds one file at a time.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with open_read(path) as f:
                    shard = Shard(f.read())
                doc_ids, lengths = shard.documents()
                ends = np.cumsum(lengths)
                tokens = shard.decode()
                for at in range(0, len(doc_ids), 2048):
                    some = range(at, min(at + 2048, len(doc_ids)))
                    ids = [tokens[ends[i] - lengths[i] : ends[i]].astype("<u4") for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_ids[i] for i in some]),
                            pa.array([start + int(ends[i] - lengths[i]) for i in some], pa.int64()),
                            pa.array([int(lengths[i]) for i in some], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task(batches):
            doc_id = batch.column(0)
            wanted = pa.string() if id_type == "string" else pa.int64()
            columns = [doc_id.cast(wanted), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kind = "string" if id_type == "string" else "bigint"
    return (
        in_tasks(files.select("path", "start"), FILES_PER_TASK)
        .mapInArrow(typed, f"doc_id {kind}, start long, n_tokens long, ids binary")
        .withColumn("doc_id", F.col("doc_id").cast(id_type))
    )
