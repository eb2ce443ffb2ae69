"""WARC archives in Zstandard: one frame per record, after a skippable frame with the dictionary."""

from __future__ import annotations

import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import in_tasks, look_up, slices
from keepsake.session import new_folder, stage_table
from keepsake.sources.storage import open_read, replacing

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D  # skippable frame that holds the dictionary of a .warc.zst
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

#: A dictionary is made from so many payloads of a file's first batch and is this long at most.
DICTIONARY_SAMPLES, DICTIONARY_BYTES = 256, 64 * 1024
_NAME = uuid.UUID("8a2f5b1e-6c7d-5f34-9b0a-3d1c2e4f5a6b")
_DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch time


class BadRecord(ValueError):
    pass


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAME, repr(page_id))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def render(
    page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object
) -> bytes:
    """One record. A revisit keeps the response's header lines, which tell its payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            f"WARC-Profile: {SAME_PAYLOAD}",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return b"\r\n".join([VERSION, *(x.encode() for x in lines), b"", block]) + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord(f"bad header line {line[:80]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and body of one record, checked: version, needed headers, length of
    the block, its digest, and for a response the length and digest of the payload."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise BadRecord(f"not a record: {record[:40]!r}")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdigit():
        raise BadRecord("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadRecord(f"block has {len(rest) - 4} bytes, not {n}")
    block = rest[:n]
    _same_digest(headers.get("warc-block-digest"), block, "block")
    http: dict[str, str] = {}
    body = block
    if headers.get("content-type", "").startswith("application/http"):
        lead, gap, body = block.partition(b"\r\n\r\n")
        if not gap:
            raise BadRecord("HTTP headers cut short")
        http = _headers(lead.split(b"\r\n")[1:])
        if headers["warc-type"] == "response":
            if int(http.get("content-length", len(body))) != len(body):
                raise BadRecord("payload has another length than its header says")
            _same_digest(headers.get("warc-payload-digest"), body, "payload")
    return headers, http, body


def _same_digest(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.startswith("sha256:"):
        if hashlib.sha256(data).hexdigest() != stated[7:]:
            raise BadRecord(f"{what} differs from its digest")


def write_head(out: BinaryIO, samples: list[bytes]):
    """Write the dictionary's frame; returns the compressor of the records."""
    import zstandard

    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        made = b""
    if not made:
        return zstandard.ZstdCompressor(level=3, write_checksum=True)
    packed = zstandard.ZstdCompressor(level=3).compress(made)
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    return zstandard.ZstdCompressor(
        level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(made)
    )


def read_records(source: BinaryIO, read_bytes: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive: the dictionary from the leading skippable frame, if there is
    one, then one record per frame. No more than one record and ``read_bytes`` are held."""
    import zstandard

    data = source.read(read_bytes)
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (size,) = struct.unpack_from("<I", data, 4)
        while len(data) < 8 + size:
            more = source.read(read_bytes)
            if not more:
                raise BadRecord("dictionary cut short")
            data += more
        made, data = data[8 : 8 + size], data[8 + size :]
        if made[:4] == ZSTD_MAGIC:
            made = zstandard.ZstdDecompressor().decompress(made)
        dictionary = zstandard.ZstdCompressionDict(made)
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or source.read(read_bytes)
        if not data:
            return
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not data:
                data = source.read(read_bytes)
                if not data:
                    raise BadRecord("frame cut short")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add payload, payload_digest and refers_to to ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is the
    response. Rows that repeat this page_id are responses too, as is every row of a payload whose
    ids are all null; null html is an empty payload.
    """
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    many = (
        rows.filter(F.length("payload") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
        .filter((F.col("rows") > 1) & F.col("first").isNotNull())
        .select("payload_digest", "first")
    )
    spread = F.struct("page_id", "url")
    joined = look_up(rows, "payload_digest", spread, many, "left")
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 100,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``.warc.zst`` files of about ``file_bytes`` of
    payload each and return them: path, records. A repeated task replaces its files."""
    folder = (folder or new_folder(pages.sparkSession, "warc")).rstrip("/")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = slices(batches)
        batch, number = next(rows, None), 0
        while batch is not None:
            path = f"{folder}/part-{part:06d}-{number:06d}.warc.zst"
            records = held = 0
            with replacing(path) as out:
                first = batch.column(2).slice(0, DICTIONARY_SAMPLES).to_pylist()
                pack = write_head(out, first)
                while batch is not None and held < file_bytes:
                    for row in zip(*(c.to_pylist() for c in batch.columns)):
                        out.write(pack.compress(render(*row)))
                        records, held = records + 1, held + len(row[2])
                    batch = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"]
            )

    written = with_revisits(pages, least_bytes).mapInArrow(task, "path string, records long")
    return stage_table(written, "warc-files")


_READ = (
    "page_id string, url string, record_type string, payload_bytes long, payload_digest string,"
    " refers_to string, payload binary"
)


def read_archives(files: DataFrame) -> DataFrame:
    """Read the archives at ``path``, checking every record; a bad one fails the task.

    Returns page_id, url, record_type, payload_bytes and payload_digest (of the full payload, for
    a revisit as its headers state them), refers_to, payload (null for a revisit).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with open_read(path) as source:
                    for record in read_records(source):
                        headers, http, body = parse(record)
                        kind = headers["warc-type"]
                        revisit = kind == "revisit"
                        rows.append(
                            (
                                headers.get("x-page-id"),
                                headers.get("warc-target-uri"),
                                kind,
                                int(http.get("content-length", len(body))),
                                headers.get("warc-payload-digest", "").removeprefix("sha256:"),
                                headers.get("x-refers-to-page"),
                                None if revisit else body,
                            )
                        )
                        size += len(body)
                        if len(rows) >= 2048 or size > 8 << 20:
                            yield _as_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _as_batch(rows)

    return in_tasks(files.select("path")).mapInArrow(task, _READ)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _READ.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
    )
