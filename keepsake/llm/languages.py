"""Language identification: each document is a mixture of languages.

Per language, the likelihood of hashed byte n-grams is counted over all training rows. For a
document, expectation-maximisation finds the proportions of the languages that explain its
n-grams; of the nested sets of its most likely languages the one with the greatest penalised
likelihood is kept, and its largest language is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import add_columns, slices, sum_arrays, texts_of

UNKNOWN = "und"
BINS = 1 << 16
#: More languages than this are refused: the model that every task gets grows with them.
MOST_LANGUAGES = 400

# Signs, digits and white space of ASCII all become one blank; letters go to lower case.
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[: ord("a")] = 0x20
_CLEAN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLEAN[ord("z") + 1 : 0x80] = 0x20


def grams(text: bytes) -> np.ndarray:
    """The bins of a text's n-grams of four bytes, words apart by one blank."""
    data = _CLEAN[np.frombuffer(b" " + text + b" ", np.uint8)]
    data = data[np.concatenate(([True], (data[1:] != 0x20) | (data[:-1] != 0x20)))]
    if len(data) < 4:
        return np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        key = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # bins x languages
    common: int  # the language with most n-grams
    penalty: float
    rounds: int

    def _fit(self, seen: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        total = counts.sum()
        for _ in range(self.rounds):
            new = share * (seen.T @ (counts / (seen @ share))) / total
            if np.abs(new - share).max() < 1e-4:
                return new
            share = new
        return share

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found = grams(text)
        if not len(found):  # a single letter: nothing to go by but the languages themselves
            return self.languages[self.common], 1 / len(self.languages)
        own = np.bincount(found, minlength=BINS)
        bins = np.flatnonzero(own)
        counts, seen = own[bins].astype(float), self.likelihood[bins]
        n = len(self.languages)
        share = self._fit(seen, counts, np.full(n, 1 / n))
        order = np.argsort(-share, kind="stable")
        best = None
        for size in range(1, n + 1):
            part = order[:size]
            start = share[part] + 1e-9
            fitted = np.ones(1) if size == 1 else self._fit(seen[:, part], counts, start / start.sum())
            score = float(counts @ np.log(seen[:, part] @ fitted))
            score -= self.penalty * (size - 1) * np.log(counts.sum())
            if best is not None and score <= best[0]:
                break  # the larger sets add languages that explain even less
            best = score, part, fitted
        top = int(np.argmax(best[2]))
        return self.languages[int(best[1][top])], float(min(best[2][top], 1.0))


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(
    docs: DataFrame,
    use: Column,
    penalty: float = 8.0,
    rounds: int = 12,
    smoothing: float = 0.5,
) -> Model:
    """Count the n-grams of every row of ``docs`` (text, lang) for which ``use`` holds.

    Rows with null lang or text teach nothing; without any such row every prediction is ``und``.
    Each task counts its own rows and the counts are added up in rounds, so what is shuffled is one
    array per language and task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(found), pa.int64()),
                    pa.array(list(found), pa.string()),
                    pa.array([v.astype("<i8").tobytes() for v in found.values()], pa.binary()),
                ],
                names=["part", "key", "values"],
            )

        for batch in slices(batches):
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                if lang not in found:
                    if len(found) >= 64:
                        yield out()
                        found.clear()
                    found[lang] = np.zeros(BINS, np.int64)
                found[lang] += np.bincount(grams(text), minlength=BINS)
        if found:
            yield out()

    rows = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        task, "part long, key string, values binary"
    )
    summed = sum_arrays(counted).orderBy("key").limit(MOST_LANGUAGES + 1).collect()
    if len(summed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = [np.frombuffer(bytes(r["values"]), "<i8") + smoothing for r in summed]
    table = np.stack([c / c.sum() for c in counts], axis=1) if counts else np.zeros((BINS, 0))
    common = int(np.argmax([c.sum() for c in counts])) if counts else 0
    return Model(tuple(r["key"] for r in summed), table, common, penalty, rounds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score (the share of that language) to every row, from its text alone.

    Null, empty and letterless texts are ``und`` with score 0. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def one(texts: list[bytes]) -> list[pa.Array]:
            found = [model.predict(t) for t in texts]
            return [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ]

        return one

    return add_columns(docs, {"lang_pred": "string", "score": "double"}, work)
