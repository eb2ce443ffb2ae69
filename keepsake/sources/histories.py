"""Manifests and chains read from a list of paths, each file once, as a stream.

The list comes from the inventory, so nobody lists folders again. A task parses its files element by
element and gives the rows of all sections together with the C4 of the bytes it read; the sections
are then picked out of that one table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.config import CHAIN_FILE, HISTORY_DIR, MANIFEST_FORMATS
from keepsake.functions.hashing import c4_text
from keepsake.sources.storage import open_read

ROWS = (
    "folder string, manifest string, section string, generation_no int, rel_path string,"
    " size bigint, modified_at string, fmt string, digest string, action string, structure string,"
    " created_at string, hostname string, tool string, tool_version string, process string,"
    " patterns array<string>, error string"
)
_KINDS = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(),
    "array<string>": pa.list_(pa.string()),
}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ROWS.split(", ")])
_AT_ONCE = 10_000
FILES_PER_TASK = 64
_NUMBER = re.compile(r"^([0-9]+)_")


def history_paths(listing: DataFrame) -> DataFrame:
    """``path`` of every manifest and chain file of an inventory (``path, kind``)."""
    name = F.element_at(F.split("path", "/"), -1)
    inside = F.element_at(F.split("path", "/"), -2) == HISTORY_DIR
    wanted = (name == CHAIN_FILE) | (name.endswith(".mhl") & ~name.startswith("._"))
    deep = F.size(F.split("path", "/")) >= 2
    return listing.where((F.col("kind") == "file") & deep).where(inside & wanted).select("path")


class _Hashed:
    """A source whose bytes are hashed as they are read."""

    def __init__(self, source: BinaryIO) -> None:
        self._source, self.state = source, hashlib.sha512()

    def read(self, n: int = -1) -> bytes:
        data = self._source.read(n)
        self.state.update(data)
        return data


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element, name: str) -> str | None:
    found = next((x for x in element if _plain(x.tag) == name), None)
    return None if found is None else found.text


def _hashes(element: ElementTree.Element | None) -> list[tuple[str, str | None, str | None]]:
    if element is None:
        return []
    return [
        (_plain(x.tag), x.text, x.get("action")) for x in element if _plain(x.tag) in MANIFEST_FORMATS
    ]


def _part(element: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((x for x in element if _plain(x.tag) == name), None)


def _folder_rows(element: ElementTree.Element, path: str) -> Iterator[dict]:
    structures = {fmt: text for fmt, text, _ in _hashes(_part(element, "structure"))}
    for fmt, text, _ in _hashes(_part(element, "content")):
        yield {"section": "folder", "rel_path": path, "fmt": fmt, "digest": text,
               "structure": structures.get(fmt)}


def _element_rows(tag: str, depth: int, element: ElementTree.Element) -> Iterator[dict]:
    """The rows of one element that has ended; ``depth`` counts the elements around it."""
    if tag == "hash":
        path = _part(element, "path")
        if path is None:
            return
        size = path.get("size")
        for fmt, text, action in _hashes(element):
            yield {"section": "file", "rel_path": path.text, "fmt": fmt, "digest": text,
                   "action": action, "size": int(size) if size and size.isdigit() else None,
                   "modified_at": path.get("lastmodificationdate")}
    elif tag == "directoryhash":
        yield from _folder_rows(element, _text(element, "path") or "")
    elif tag == "processinfo":
        ignore, root = _part(element, "ignore"), _part(element, "roothash")
        yield {"section": "process", "process": _text(element, "process"),
               "patterns": None if ignore is None else [x.text for x in ignore]}
        if root is not None:
            yield from _folder_rows(root, "")
    elif tag == "creatorinfo":
        tool = _part(element, "tool")
        yield {"section": "creator", "created_at": _text(element, "creationdate"),
               "hostname": _text(element, "hostname"),
               "tool": None if tool is None else tool.text,
               "tool_version": None if tool is None else tool.get("version")}
    elif tag == "hashlistreference":
        yield {"section": "reference", "rel_path": _text(element, "path"), "digest": _text(element, "c4")}
    elif tag == "hashlist" and depth == 1 and element.get("sequencenr"):
        yield {"section": "chain", "generation_no": int(element.get("sequencenr")),
               "rel_path": _text(element, "path"), "digest": _text(element, "c4")}


_ENDS = ("hash", "directoryhash", "processinfo", "creatorinfo", "hashlistreference", "hashlist")


def parse_history(source: BinaryIO) -> Iterator[dict]:
    """The rows of one file, then a ``bytes`` row with the C4 of what was read.

    An element is dropped as soon as its rows are out, so a manifest of any length takes little
    memory. A file that is no well-formed XML ends with an ``error`` row after what came before.
    """
    hashed = _Hashed(source)
    around: list[ElementTree.Element] = []
    try:
        for event, element in ElementTree.iterparse(hashed, ("start", "end")):
            if event == "start":
                around.append(element)
                continue
            around.pop()
            tag = _plain(element.tag)
            if tag in _ENDS and around:
                yield from _element_rows(tag, len(around), element)
                around[-1].remove(element)
    except (ElementTree.ParseError, ValueError) as exc:
        yield {"section": "error", "error": str(exc)}
        while hashed.read(1 << 20):
            pass
    yield {"section": "bytes", "digest": c4_text(hashed.state.digest())}


def read_histories(files: DataFrame, root: str) -> DataFrame:
    """All sections of the history files at ``path`` (relative to ``root``, see
    :func:`history_paths`); ``folder`` is the folder that a history describes.

    Sections: ``file`` (a row per format), ``folder`` (``digest`` is the content hash; the root
    folder is ``""``), ``process``, ``creator``, ``reference`` and ``chain`` (``rel_path`` is the
    manifest, ``digest`` its C4), ``bytes`` (the C4 of the file itself) and ``error``. A file that
    cannot be opened is an ``error`` row.
    """
    count = files.count()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                folder = folder.rpartition("/")[0]
                number = _NUMBER.match(name)
                head = {"folder": folder, "manifest": name,
                        "generation_no": int(number[1]) if number else None}
                try:
                    with open_read(f"{root}/{path}") as source:
                        for row in parse_history(source):
                            held.append(head | row)
                            if len(held) >= _AT_ONCE:
                                yield pa.RecordBatch.from_pylist(held, _ARROW)
                                held = []
                except OSError as exc:
                    held.append(head | {"section": "error", "error": exc.strerror or str(exc)})
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    tasks = max(1, -(-count // FILES_PER_TASK))
    return files.select("path").repartition(tasks).mapInArrow(parse, ROWS)


def section(histories: DataFrame, name: str) -> DataFrame:
    """The rows of one section, with the columns that it has."""
    head = ["folder", "manifest", "generation_no"]
    rows = histories.where(F.col("section") == name)
    return {
        "file": lambda: rows.select(
            *head, "rel_path", "size", "modified_at", "fmt", "digest", "action"
        ),
        "folder": lambda: rows.select(
            *head, "rel_path", "fmt", F.col("digest").alias("content"), "structure"
        ),
        "reference": lambda: rows.select(
            *head, F.col("rel_path").alias("path"), F.col("digest").alias("c4")
        ),
        "chain": lambda: rows.select(
            "folder", "generation_no", F.col("rel_path").alias("manifest"),
            F.col("digest").alias("c4"),
        ),
        "bytes": lambda: rows.select("folder", "manifest", F.col("digest").alias("actual")),
        "error": lambda: rows.select("folder", "manifest", "error"),
    }[name]()
