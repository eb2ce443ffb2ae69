"""Path columns. A path is POSIX text; its components are ``split(path, '/')``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(components(path), -1)


def parent(path: Column) -> Column:
    """Folder of ``path``; empty text at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    """Number of folders above the entry."""
    return F.size(components(path)) - 1


def ancestors(path: Column) -> Column:
    """Every folder above ``path``, outermost first, without a trailing slash."""
    parts = components(path)
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, 1, i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def suffix(path: Column) -> Column:
    """Lower-case suffix of the name from its last dot; empty for none or a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), "^.+([.][^.]+)$", 1))


def resolve(folder: Column, name: Column) -> Column:
    """``folder/name`` with ``\\`` read as ``/`` and ``.``, ``..`` and empty parts resolved."""
    name = F.replace(name, F.lit("\\"), F.lit("/"))
    absolute = name.startswith("/")
    full = F.when(absolute, name).otherwise(F.concat_ws("/", folder, name))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        can_climb = (F.size(done) > 0) & (last != "..")
        climbed = (
            F.when(can_climb, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", climbed)
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(components(full), none, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(
        F.when(joined == "", ".").otherwise(joined)
    )


def starts_with_any(text: Column, prefixes: str) -> Column:
    """First character is one of ``prefixes``."""
    return F.lit(prefixes).contains(F.substring(text, 1, 1)) & (text != "")
