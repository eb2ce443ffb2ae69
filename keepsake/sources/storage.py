"""Opening, listing and writing archive files inside tasks.

Mounted folders go through ``os``, which keeps nanosecond mtimes and tells symlinks apart; a URI
of another scheme goes through Arrow's file systems.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO


def local_path(path: str) -> str | None:
    """The mounted path of ``path``, or None if it is a URI of another scheme."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_read(path: str) -> BinaryIO:
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    system, name = _remote(path)
    return system.open_input_stream(name)


def _open_new(path: str) -> BinaryIO:
    """Opened for writing; the folder is only looked after if it is not there."""
    try:
        return open(path, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")


def open_write(path: str) -> BinaryIO:
    """A new file under a name nobody else uses."""
    local = local_path(path)
    if local is not None:
        return _open_new(local)
    system, name = _remote(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def stat_of(path: str) -> tuple[int, int]:
    """``(size, mtime_ns)``."""
    local = local_path(path)
    if local is not None:
        found = os.stat(local)
        return found.st_size, found.st_mtime_ns
    system, name = _remote(path)
    info = system.get_file_info(name)
    return info.size, info.mtime_ns or 0


@contextmanager
def replacing(path: str) -> Iterator[BinaryIO]:
    """Write beside ``path`` and move into place when whole, so a retried task repeats safely."""
    local = local_path(path)
    mark = f".{uuid.uuid4().hex}.tmp"
    if local is not None:
        folder, name = os.path.split(local)
        beside = os.path.join(folder, f".{name}{mark}")
        with _open_new(beside) as out:
            yield out
        os.replace(beside, local)
        return
    system, name = _remote(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name + mark) as out:
        yield out
    system.move(name + mark, name)


def touch(path: str) -> None:
    """Give a file the mtime of now; its bytes stay as they are."""
    local = local_path(path)
    if local is not None:
        os.utime(local)
        return
    with open_read(path) as source, replacing(path) as out:
        while block := source.read(1 << 20):
            out.write(block)


def entries(folder: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    """``(name, kind, size, mtime_ns, error)`` of a folder's entries; no content is read.

    ``kind`` is file, folder, symlink or other. An entry that cannot be read keeps its error.
    """
    local = local_path(folder)
    if local is None:
        from pyarrow import fs

        system, name = _remote(folder)
        for info in system.get_file_info(fs.FileSelector(name)):
            kind = "folder" if info.type == fs.FileType.Directory else "file"
            yield info.base_name, kind, info.size or 0, info.mtime_ns or 0, None
        return
    with os.scandir(local) as found:
        for entry in found:
            try:
                if entry.is_symlink():
                    yield entry.name, "symlink", 0, 0, None
                elif entry.is_dir(follow_symlinks=False):
                    yield entry.name, "folder", 0, 0, None
                elif entry.is_file(follow_symlinks=False):
                    stat = entry.stat(follow_symlinks=False)
                    yield entry.name, "file", stat.st_size, stat.st_mtime_ns, None
                else:
                    yield entry.name, "other", 0, 0, None
            except OSError as exc:
                yield entry.name, "other", 0, 0, exc.strerror or str(exc)
