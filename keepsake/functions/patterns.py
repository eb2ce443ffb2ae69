"""Ignore patterns and globs as regular-expression columns, compiled once on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.config import HISTORY_DIR
from keepsake.functions.paths import ancestors, basename


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_/" or ord(ch) > 127 else "\\" + ch


def _bracket(text: str, i: int) -> tuple[str, int] | None:
    """The class opened at ``text[i]`` and the index after it, or None if it never closes."""
    close = text.find("]", i + 2 if text[i + 1 : i + 2] not in "!^" else i + 3)
    if close < 0:
        return None
    body = text[i + 1 : close]
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    body = "".join("\\" + c if c in "\\[]^&~" else c for c in body)
    return f"[{'^' if negated else ''}{body}]", close + 1


def glob_regex(glob: str) -> str:
    """fnmatch, case-sensitive, as a full-match expression."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        found = _bracket(glob, i) if ch == "[" else None
        if found:
            out, i = out + found[0], found[1]
            continue
        out += {"*": ".*", "?": "."}.get(ch) or _literal(ch)
        i += 1
    return f"(?s)^{out}$"


def _segment_regex(segment: str) -> str:
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        if ch == "\\" and i + 1 < len(segment):
            out, i = out + _literal(segment[i + 1]), i + 2
            continue
        found = _bracket(segment, i) if ch == "[" else None
        if found:
            out, i = out + found[0], found[1]
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or _literal(ch)
        i += 1
    return out


def ignore_rule(line: str) -> tuple[bool, bool, str] | None:
    """``(negated, folders only, expression)`` of one gitignore line; None for a comment.

    The expression covers one whole path without its trailing slash.
    """
    text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    folders_only = text.endswith("/") and not text.endswith("\\/")
    text = text.rstrip("/") if folders_only else text
    anchored = "/" in text
    segments = [s for s in text.split("/") if s]
    if not segments:
        return None
    out = "" if anchored else "(?:.*/)?"
    for n, segment in enumerate(segments):
        last = n == len(segments) - 1
        if segment == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment_regex(segment) + ("" if last else "/")
    return negated, folders_only, out


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """True if gitignore ``patterns`` drop the project-relative file ``path``.

    An ignored folder takes everything below it along, so nothing below can be brought back.
    The history folder at the top of a project is always dropped.
    """
    rules = [r for r in map(ignore_rule, patterns) if r is not None]
    history = path.startswith(HISTORY_DIR + "/")
    if not rules:
        return history
    if not any(negated for negated, _, _ in rules):
        branches = [r + ("/.*" if folders else "(?:/.*)?") for _, folders, r in rules]
        return history | path.rlike(f"(?s)^(?:{'|'.join(branches)})$")

    def decided(entry: Column, folder: bool) -> Column:
        """The last matching rule decides."""
        verdict = F.lit(False)
        for negated, folders, expression in rules:
            if folders and not folder:
                continue
            verdict = F.when(entry.rlike(f"(?s)^{expression}$"), F.lit(not negated)).otherwise(
                verdict
            )
        return verdict

    return history | F.exists(ancestors(path), lambda a: decided(a, True)) | decided(path, False)


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """True if one of ``globs`` matches the name of the file."""
    out = F.lit(False)
    for glob in globs:
        out = out | basename(path).rlike(glob_regex(glob))
    return out


def escaped_prefixes(prefixes: str, root_path: str = "/") -> list[str]:
    """One ``<prefix>*`` pattern per ignore prefix.

    A prefix that starts a component of the archive's own path would ignore all of it: skipped.
    """
    parts = [p for p in root_path.split("/") if p]
    out = []
    for ch in dict.fromkeys(prefixes):
        if not any(part.startswith(ch) for part in parts):
            out.append(("\\" + ch if ch in "\\*?[]!#" else ch) + "*")
    return out
