"""Digest columns. ``md5`` and ``sha1`` stay in the JVM; the others hash Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet and width of a C4 identifier.
C4_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
C4_LENGTH = 90


def c4_text(sha512_digest: bytes) -> str:
    """A SHA-512 digest as a C4 identifier."""
    number, out = int.from_bytes(sha512_digest, "big"), ""
    while number:
        number, rest = divmod(number, 58)
        out = C4_ALPHABET[rest] + out
    return "c4" + out.rjust(C4_LENGTH - 2, C4_ALPHABET[0])


class C4:
    """hashlib-shaped C4."""

    def __init__(self) -> None:
        self._inner = hashlib.sha512()

    def update(self, data: bytes) -> None:
        self._inner.update(data)

    def hexdigest(self) -> str:
        return c4_text(self._inner.digest())


HASHERS = {
    "xxh128": xxhash.xxh128,
    "xxh64": xxhash.xxh64,
    "xxh3": xxhash.xxh3_64,
    "md5": hashlib.md5,
    "sha1": hashlib.sha1,
    "c4": C4,
}


def check_formats(formats: object, allowed: object = HASHERS) -> None:
    unknown = [f for f in formats if f not in allowed]
    if unknown:
        raise ValueError(f"unsupported hash formats: {unknown}")


def digest(content: Column, fmt: str) -> Column:
    """Lower-case digest of a binary (or text) column."""
    check_formats([fmt])
    if fmt == "md5":
        return F.md5(content)
    if fmt == "sha1":
        return F.sha1(content)
    make = HASHERS[fmt]

    @F.pandas_udf("string")
    def batch(values: pd.Series) -> pd.Series:
        def one(value: bytes | None) -> str | None:
            if value is None:
                return None
            hasher = make()
            hasher.update(value)
            return hasher.hexdigest()

        return values.map(one)

    return batch(content.cast("binary"))
