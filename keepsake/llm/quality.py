"""Quality classifier: random-indexing word vectors, pooled, and a network of two layers.

Every word and run of signs has a fixed sparse random vector; the vector of a word is the sum of
those of its neighbours over the whole corpus. A document is the mean and the spread of its words'
vectors. A network of two layers turns that into a logit, and a temperature fitted on rows that
the network has not seen turns the logit into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import (
    WORDS_AND_SIGNS,
    add_columns,
    kept,
    mixed,
    run_hashes,
    slices,
    sum_arrays,
    texts_of,
)

WORDS, DIMS, NONZERO, REACH = 1 << 14, 48, 4, 2
CHUNKS = 16  # pieces in which word vectors travel
COUNT_AT_ONCE = 1 << 17  # words whose neighbours a task counts at once
#: Labelled rows that the network is fitted on at most: those whose id has the smallest hashes.
TRAIN_ROWS = 12_000
FEATURES = 2 * DIMS + 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each word's random vector, by rule."""
    seeds = np.arange(WORDS * NONZERO, dtype=np.uint64).reshape(WORDS, NONZERO) + np.uint64(1)
    with np.errstate(over="ignore"):
        random = mixed(seeds * np.uint64(0x9E3779B97F4A7C15))
    return (random % np.uint64(DIMS)).astype(np.int64), 1 - 2 * (random >> np.uint64(63)).astype(
        np.int64
    )


def words_of(text: bytes) -> np.ndarray:
    """The bins of a text's words and runs of signs; capital letters count."""
    hashes, _ = run_hashes(text, WORDS_AND_SIGNS)
    return (hashes >> np.uint64(50)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context sums of every bin over all texts, each scaled to length 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        places, signs = kept("index vectors", _index_vectors)
        total = np.zeros(WORDS * DIMS, np.int64)
        held: list[np.ndarray] = []
        gap = np.full(REACH, -1)

        def count() -> None:
            words = np.concatenate(held)
            for step in range(1, REACH + 1):
                left, right = words[:-step], words[step:]
                both = (left >= 0) & (right >= 0)
                left, right = left[both], right[both]
                for word, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        key, sign = word * DIMS + places[other, k], signs[other, k]
                        for s in (1, -1):
                            total[:] += s * np.bincount(key[sign == s], minlength=len(total))

        size = 0
        for batch in slices(batches):
            for text in texts_of(batch.column(0)):
                held += [words_of(text), gap]
                size += len(held[-2])
                if size > COUNT_AT_ONCE:
                    count()
                    held, size = [], 0
        if held:
            count()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * CHUNKS, pa.int64()),
                pa.array(range(CHUNKS), pa.int32()),
                pa.array([x.tobytes() for x in np.split(total, CHUNKS)], pa.binary()),
            ],
            names=["part", "key", "values"],
        )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(
        task, "part long, key int, values binary"
    )
    out = np.zeros((CHUNKS, WORDS * DIMS // CHUNKS))
    for row in sum_arrays(counted, at_once=16).collect():  # CHUNKS rows, 6 MB in all
        out[row["key"]] = np.frombuffer(bytes(row["values"]), "<i8")
    table = np.sign(out) * np.sqrt(np.abs(out))
    table = table.reshape(WORDS, DIMS)
    # What all words share tells nothing about one of them.
    used = np.abs(table).sum(axis=1) > 0
    if used.any():
        table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True)
        table[used] -= table[used].mean(axis=0)
    return table.astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, log of their number, share of words among the runs."""
    hashes, kinds = run_hashes(text, WORDS_AND_SIGNS)
    out = np.zeros(FEATURES, np.float32)
    if len(hashes):
        own = vectors[(hashes >> np.uint64(50)).astype(np.int64)]
        out[:DIMS], out[DIMS : 2 * DIMS] = own.mean(axis=0), own.std(axis=0)
        out[-2:] = np.log1p(len(hashes)) / 10, (kinds == 1).mean()
    return out


@dataclass(frozen=True)
class Network:
    vectors: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(((features - self.middle) / self.scale) @ w1 + b1)
        return (hidden @ w2 + b2)[:, 0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        features = np.stack([pooled(t, self.vectors) for t in texts])
        return _sigmoid(self.logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def fit_network(
    features: np.ndarray,
    labels: np.ndarray,
    vectors: np.ndarray,
    hidden: int = 32,
    epochs: int = 60,
    rate: float = 3e-3,
    decay: float = 1e-4,
) -> Network:
    """Adam on four fifths of the rows; the rest choose the best epoch and the temperature.

    Without rows every text scores 0.5; with rows of one class all scores lean to that class.
    """
    random = np.random.default_rng(7)
    width = vectors.shape[1] * 2 + 2
    middle = features.mean(axis=0) if len(features) else np.zeros(width)
    scale = features.std(axis=0) + 1e-6 if len(features) else np.ones(width)
    x = (features - middle) / scale
    weights = [
        random.normal(0, width**-0.5, (width, hidden)),
        np.zeros(hidden),
        np.zeros((hidden, 1)),
        np.zeros(1),
    ]
    net = Network(vectors, middle, scale, tuple(weights), 1.0)
    if not len(x):
        return net
    rows = random.permutation(len(x))
    held = rows[: len(x) // 5]
    own = rows[len(x) // 5 :]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    best, step = (np.inf, net.weights), 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(own), max(1, len(own) // 128)):
            inner = np.tanh(x[batch] @ weights[0] + weights[1])
            error = _sigmoid(inner @ weights[2] + weights[3]) - labels[batch, None]
            error /= len(batch)
            back = (error @ weights[2].T) * (1 - inner**2)
            slopes = [
                x[batch].T @ back + decay * weights[0],
                back.sum(axis=0),
                inner.T @ error + decay * weights[2],
                error.sum(axis=0),
            ]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                step_size = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                weights[k] = weights[k] - step_size * first[k] / (np.sqrt(second[k]) + 1e-8)
        now = Network(vectors, middle, scale, tuple(weights), 1.0)
        check = held if len(held) else own
        loss = _loss(now.logits(features[check]), labels[check])
        if loss < best[0]:
            best = loss, now.weights
    done = Network(vectors, middle, scale, best[1], 1.0)
    check = held if len(held) else own
    logits = done.logits(features[check])
    grid = np.exp(np.linspace(-1.5, 1.5, 121))
    temperature = min(grid, key=lambda t: _loss(logits / t, labels[check]))
    return Network(vectors, middle, scale, best[1], float(temperature))


def train(
    docs: DataFrame, labels: DataFrame, use: Column, train_rows: int = TRAIN_ROWS
) -> Network:
    """Word vectors from every text of ``docs`` (doc_id, text); the network from ``labels``
    (doc_id, quality) rows for which ``use``, a condition on doc_id, holds.

    At most ``train_rows`` labelled rows are taken, those whose id hashes lowest; null ids and
    labels teach nothing. Their features, not their texts, come to the driver.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = (
        labels.filter(use & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("__label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__label")
        .limit(train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work():
        vectors = shared.value
        return lambda texts: [
            pa.array([pooled(t, vectors).tobytes() for t in texts], pa.binary())
        ]

    found = (
        add_columns(rows.select("doc_id", "__label", "text"), {"__features": "binary"}, work)
        .select("doc_id", "__label", "__features")
        # An id may name many rows; so many are enough.
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__label", "__features")
        .limit(2 * train_rows)
        .collect()
    )
    shared.destroy()
    features = np.array(
        [np.frombuffer(bytes(r["__features"]), np.float32) for r in found], np.float64
    ).reshape(-1, FEATURES)
    return fit_network(features, np.array([float(r["__label"]) for r in found]), vectors)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """Add score (probability of label 1, from the text alone) and predicted to every row.

    Null and empty texts have features of their own (no words) and so a score. Columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work():
        network = shared.value

        def one(texts: list[bytes]) -> list[pa.Array]:
            scores = network.score(texts)
            return [
                pa.array(scores, pa.float64()),
                pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
            ]

        return one

    return add_columns(docs, {"score": "double", "predicted": "int"}, work)
