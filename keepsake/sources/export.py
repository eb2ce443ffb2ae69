"""Manifest and chain files from history tables.

Spark renders the lines, range-partitions and sorts them; each task joins its run of a file's
lines into one part, and one task per file copies the parts in order. The rows of a huge manifest
are never gathered: what passes through its last task are bytes, block by block.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.config import CHAIN_FILE, CHAIN_NAMESPACE, HISTORY_DIR, MANIFEST_NAMESPACE
from keepsake.functions.hashing import c4_text
from keepsake.functions.times import iso_text
from keepsake.session import new_folder, stage
from keepsake.sources.storage import open_read, open_write, replacing, touch

BY = ("project",)
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def xml_text(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _element(name: str, text: Column, indent: int, attributes: Column | str = "") -> Column:
    pad = "  " * indent
    return _cat(f"{pad}<{name}", attributes, ">", xml_text(text), f"</{name}>\n")


def _hash_lines(indent: int) -> Column:
    """``hashes`` (sorted by format, the order of the schema) as elements."""
    pad = "  " * indent
    return F.array_join(
        F.transform(
            "hashes",
            lambda h: _cat(
                pad, "<", h["fmt"],
                F.when(h["action"].isNotNull(), _cat(' action="', h["action"], '"')).otherwise(""),
                ">", h["digest"], "</", h["fmt"], ">\n",
            ),
        ),
        "",
    )


def manifest_lines(
    generations: DataFrame,
    files: DataFrame | None = None,
    folders: DataFrame | None = None,
    references: DataFrame | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``(path, section, key, line)`` of every manifest, in the order the schema asks for.

    ``generations`` has ``manifest, created_at, hostname, tool, tool_version, patterns``; the
    others carry the project keys and ``manifest``: ``files`` with ``rel_path, size, mtime_ns,
    fmt, digest, action``, ``folders`` with ``rel_path, fmt, content, structure`` (root ``""``),
    ``references`` with ``path, c4``.
    """
    key = [*by, "manifest"]
    path = F.concat_ws("/", *by, F.lit(HISTORY_DIR), F.col("manifest")).alias("path")
    text = F.lit("")
    head = (
        _cat(_HEAD, f'<hashlist version="2.0" xmlns="{MANIFEST_NAMESPACE}">\n  <creatorinfo>\n')
    )
    head = _cat(
        head,
        _element("creationdate", iso_text(F.col("created_at")), 2),
        _element("hostname", F.col("hostname"), 2),
        _element("tool", F.col("tool"), 2, _cat(' version="', xml_text(F.col("tool_version")), '"')),
        "  </creatorinfo>\n  <processinfo>\n    <process>in-place</process>\n",
    )
    ignore = F.array_join(F.transform("patterns", lambda p: _element("pattern", p, 3)), "")
    tail = F.when(F.size("patterns") > 0, _cat("    <ignore>\n", ignore, "    </ignore>\n")).otherwise("")

    def rows(df: DataFrame, section: int, sort_key: Column, line: Column) -> DataFrame:
        return df.select(
            path, F.lit(section).alias("section"), sort_key.alias("key"), line.alias("line")
        )

    def once(df: DataFrame, section: int, line: str) -> DataFrame:
        return rows(df.select(*key).distinct(), section, text, F.lit(line))

    parts = [
        rows(generations, 0, text, head),
        rows(generations, 2, text, _cat(tail, "  </processinfo>\n")),
        rows(generations, 9, text, F.lit("</hashlist>\n")),
    ]
    listed = [df.select(*key) for df in (files, folders) if df is not None]
    if listed:
        both = reduce(DataFrame.unionByName, listed)
        parts += [once(both, 3, "  <hashes>\n"), once(both, 6, "  </hashes>\n")]
    if files is not None:
        size = F.when(F.col("size").isNotNull(), _cat(' size="', F.col("size").cast("string"), '"'))
        at = iso_text(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("bigint")))
        stamp = F.when(F.col("mtime_ns").isNotNull(), _cat(' lastmodificationdate="', at, '"'))
        per_file = files.groupBy(*key, "rel_path", "size", "mtime_ns").agg(
            F.array_sort(F.collect_list(F.struct("fmt", "digest", "action"))).alias("hashes")
        )
        line = _cat(
            "    <hash>\n",
            _element("path", F.col("rel_path"), 3,
                     _cat(F.coalesce(size, text), F.coalesce(stamp, text))),
            _hash_lines(3),
            "    </hash>\n",
        )
        parts.append(rows(per_file, 4, F.col("rel_path"), line))
    if folders is not None:
        per_folder = folders.groupBy(*key, "rel_path").agg(
            F.array_sort(F.collect_list(F.struct("fmt", "content", "structure"))).alias("all")
        )

        def block(which: str, indent: int) -> Column:
            pad = "  " * indent
            inner = F.array_join(
                F.transform("all", lambda h: _cat(
                    pad, "  <", h["fmt"], ">", h[which], "</", h["fmt"], ">\n")), "")
            return _cat(f"{pad}<{which}>\n", inner, f"{pad}</{which}>\n")

        root = per_folder.where(F.col("rel_path") == "")
        below = per_folder.where(F.col("rel_path") != "")
        parts.append(rows(root, 1, text, _cat(
            "    <roothash>\n", block("content", 3), block("structure", 3), "    </roothash>\n")))
        parts.append(rows(below, 5, F.col("rel_path"), _cat(
            "    <directoryhash>\n", _element("path", F.col("rel_path"), 3),
            block("content", 3), block("structure", 3), "    </directoryhash>\n")))
    if references is not None:
        parts += [once(references, 7, "  <references>\n"), once(references, 8, "  </references>\n")]
        of_path = references.withColumnRenamed("path", "__path")
        parts.append(
            of_path.select(
                path, F.lit(7).alias("section"), _cat("~", F.col("__path")).alias("key"),
                _cat("    <hashlistreference>\n", _element("path", F.col("__path"), 3),
                     _element("c4", F.col("c4"), 3), "    </hashlistreference>\n").alias("line"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def chain_lines(chain: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lines of each project's chain; ``chain`` has ``generation_no, manifest, c4``."""
    path = F.concat_ws("/", *by, F.lit(f"{HISTORY_DIR}/{CHAIN_FILE}")).alias("path")
    whole = chain.select(*by).distinct()
    text = F.lit("")
    line = _cat(
        '  <hashlist sequencenr="', F.col("generation_no").cast("string"), '">\n',
        _element("path", F.col("manifest"), 2), _element("c4", F.col("c4"), 2), "  </hashlist>\n",
    )

    def rows(df: DataFrame, section: int, key: Column, value: Column) -> DataFrame:
        return df.select(path, F.lit(section).alias("section"), key.alias("key"), value.alias("line"))

    opening = F.lit(f'{_HEAD}<ascmhldirectory xmlns="{CHAIN_NAMESPACE}">\n')
    return (
        rows(whole, 0, text, opening)
        .unionByName(rows(chain, 1, F.lpad(F.col("generation_no").cast("string"), 12, "0"), line))
        .unionByName(rows(whole, 2, text, F.lit("</ascmhldirectory>\n")))
    )


INLINE = 256 * 1024  # bytes of a part that travel in the row; a longer part is a file
_PART = "path string, section int, key string, data binary, part string"


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Write each ``path`` below ``folder``; gives ``(path, bytes, c4)`` of the files.

    Lines are ordered by ``(path, section, key)``. Parts longer than :data:`INLINE` lie in the
    shared folder until it is cleared.
    """
    aside = new_folder(lines.sparkSession, "parts")

    def join_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "section", "key", "data", "part"]
        head, held, size, out, name = None, [], 0, None, None

        def close() -> pd.DataFrame:
            nonlocal out
            data = b"".join(held)
            if out is None:
                return pd.DataFrame([[*head, data, None]], columns=columns)
            out.write(data)
            out.close()
            out = None
            return pd.DataFrame([[*head, None, name]], columns=columns)

        for batch in batches:
            for row in batch.itertuples(index=False):
                if head is None or row.path != head[0]:
                    if head is not None:
                        yield close()
                    head, held, size = (row.path, row.section, row.key), [], 0
                line = row.line.encode()
                held.append(line)
                size += len(line)
                if size > INLINE:
                    if out is None:
                        name = f"{aside}/{uuid.uuid4().hex}"
                        out = open_write(name)
                    out.write(b"".join(held))
                    held, size = [], 0
        if head is not None:
            yield close()

    def copy_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = (row for batch in batches for row in batch.itertuples(index=False))
        for path, parts in itertools.groupby(rest, key=lambda row: row.path):
            total, state = 0, hashlib.sha512()
            with replacing(f"{folder}/{path}") as out:
                for row in parts:
                    for block in _blocks(row.data, row.part):
                        out.write(block)
                        state.update(block)
                        total += len(block)
            yield pd.DataFrame(
                [[path, total, c4_text(state.digest())]], columns=["path", "bytes", "c4"]
            )

    order = ["path", "section", "key"]
    runs = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stage(runs.select(*order, "line").mapInPandas(join_lines, _PART))
    placed = parts.repartition("path").sortWithinPartitions(*order)
    return placed.mapInPandas(copy_parts, "path string, bytes bigint, c4 string")


def _blocks(data: bytes | None, part: str | None) -> Iterator[bytes]:
    if part is None:
        yield data
        return
    with open_read(part) as source:
        while block := source.read(8 * 1024 * 1024):
            yield block


def write_contents(files: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of each ``path`` below ``folder``; gives ``(path, bytes)``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with replacing(f"{folder}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["content"].map(len)})

    return files.select("path", "content").mapInPandas(write, "path string, bytes bigint")


def touch_files(files: DataFrame, folder: str) -> DataFrame:
    """Give each ``path`` below ``folder`` a new mtime and leave its bytes; gives ``path``."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                touch(f"{folder}/{path}")
            yield batch[["path"]]

    return files.select("path").mapInPandas(again, "path string")
