"""Exact Jaccard join of documents' word n-gram sets, and the groups that its links make.

Rows with equal sets are one node. Each node is indexed under signatures of the prefix of its set,
rare n-grams first; two sets that are similar enough always have a signature in common:

* N-grams fall in classes by the share of documents that hold them. A rare n-gram is a signature
  by itself. Of a frequent class, which is split further by hash, combinations of ``k`` n-grams
  are signatures, and the prefix is longer by ``k - 1`` n-grams for each part of a class in it.
  Larger sets have more parts, so that signatures grow like the set: sizes fall in bands, each with
  its number of parts, and a set that may be linked with one of the next band is indexed for both.
* A prefix is long enough when leaving out any ``n - ceil(t * n)`` of its n-grams leaves ``k`` of
  one class. Sets too small for that are also indexed among each other by single n-grams.

Candidates that a signature brings together are verified on their whole sets. So that a large
group of copies does not give all its pairs, each member of a signature is first compared with one
pivot, the member that holds fewest rarer n-grams; only members whose groups still differ after
that are compared with each other.

Sets are of 64-bit hashes of n-grams: two different n-grams of a pair of documents with n and m
n-grams are taken for one with a chance of n * m / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from keepsake.llm.common import (
    BETWEEN_SPACE,
    look_up,
    mixed,
    run_hashes,
    slices,
    sum_arrays,
    texts_of,
)
from keepsake.session import stage_table

BINS = 1 << 21  # in which the documents that hold an n-gram are counted
_TO_BIN = np.uint64(43)
CHUNKS = 32  # pieces in which the counts travel
PROFILE = 128  # ranges of hashes that are counted per set
AT_ONCE = 1 << 18  # signatures that leave a task in one batch
MOST_BITS = 1 << 27  # of a Bloom filter, whatever the number of its members
# A staged table gets a file for so many documents or n-grams of theirs, whichever gives more.
DOCUMENTS_A_FILE, NGRAMS_A_FILE = 1 << 13, 1 << 22
_SMALL = np.uint64(0x5851F42D4C957F2D)  # marks signatures among small sets


@dataclass(frozen=True)
class Spec:
    """``percent`` is the least similarity; ``classes`` the least share of documents and the
    ``k`` of each frequent class; ``parts`` how many parts such a class has at least."""

    words: int = 5
    percent: int = 80
    classes: tuple[tuple[float, int], ...] = ((1 / 8, 2), (1 / 2, 3))
    parts: int = 16

    def __post_init__(self) -> None:
        if self.words < 1 or not 0 < self.percent <= 100 or self.parts < 1:
            raise ValueError("words and parts from 1, percent from 1 to 100")


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; of all words, if there are fewer than ``words``."""
    own, _ = run_hashes(text.lower(), BETWEEN_SPACE)  # bytes.lower changes A-Z alone
    if not len(own):
        return own
    n = min(words, len(own))
    count = len(own) - n + 1
    total = np.full(count, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + own[k : k + count]
    total = mixed(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def node_of(own: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    digest = hashlib.md5(own.tobytes()).digest()
    first, second = np.frombuffer(digest, "<i8").tolist()
    return first, second


def profile_of(own: np.ndarray) -> bytes:
    """How many hashes of a set fall in each of so many ranges, 255 at most."""
    counts = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=PROFILE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _combined(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` of the sorted ``tokens``."""
    groups = tokens[np.array(list(combinations(range(len(tokens)), k)), np.int64).reshape(-1, k)]
    total = np.full(len(groups), np.uint64(k))
    with np.errstate(over="ignore"):
        for column in groups.T:
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total


def parts_of(n: int, spec: Spec) -> list[int]:
    """Into how many parts a frequent class is split for sets that one of ``n`` may be linked with;
    two sets whose sizes allow a link have a number in common."""
    width = max(2, -(-100 // spec.percent))
    low = 1
    while low * width <= n:
        low *= width
    lows = [low, low * width] if 100 * n >= spec.percent * low * width else [low]
    more = max(1, sum(k - 1 for _, k in spec.classes))
    found = set()
    for low in lows:
        common = -(-spec.percent * low // 100)
        # The prefix, longer by the parts, must fit in the set.
        found.add(max(spec.parts, min((low - common) // 4, spec.percent * common // (200 * more))))
    return sorted(found)


def signatures(
    own: np.ndarray, held_by: np.ndarray, documents: int, spec: Spec
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, and for single n-grams how many rarer ones the set has (else -1)."""
    n = len(own)
    spare = n - -(-spec.percent * n // 100)
    counts = held_by[own >> _TO_BIN]
    borders = [share * documents for share, _ in spec.classes]
    if spare < n and (most := np.partition(counts, spare)[spare]) < borders[0]:
        own, counts = own[counts <= most], counts[counts <= most]  # rare ones are enough
    order = np.argsort(counts, kind="stable")
    own, counts = own[order], counts[order]
    rank = np.searchsorted(borders, counts, "right")  # 0 is rare
    rare = int(np.count_nonzero(rank == 0))
    single = own[: min(rare, spare + 1)]
    found, places = [mixed(single)], [np.arange(len(single))]
    if len(single) <= spare:
        small, groups = False, []
        for n_parts in parts_of(n, spec):
            left = spare + 1 - len(single)
            parts: dict[tuple[int, int], list[int]] = {}
            for token, kind in zip(own[rare:].tolist(), rank[rare:].tolist()):
                part = parts.setdefault((kind, token % n_parts), [])
                part.append(token)
                left -= len(part) >= spec.classes[kind - 1][1]
                if not left:
                    break
            for (kind, _), tokens in sorted(parts.items()):
                k = spec.classes[kind - 1][1]
                groups.append(_combined(np.sort(np.array(tokens, np.uint64)), k))
            small |= left > 0
        if groups:
            combined = np.unique(np.concatenate(groups))
            found.append(combined)
            places.append(np.full(len(combined), -1))
        if small:
            some = mixed(own[: spare + 1] ^ _SMALL)
            found.append(some)
            places.append(np.full(len(some), -1))
    return np.concatenate(found), np.concatenate(places)


def _task_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def _node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}k1").alias("k1"), F.col(f"{prefix}k2").alias("k2"))


def _read_sets(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, k1, k2, n_shingles, profile of every row; rows with counts of n-grams by bin."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts = np.zeros(BINS, np.uint32)
        id_type, waiting, waits = None, [], 0

        def counted(sets: list[np.ndarray]) -> np.ndarray:
            bins = (np.concatenate(sets or [np.empty(0, np.uint64)]) >> _TO_BIN).astype(np.int64)
            return np.bincount(bins, minlength=BINS).astype(np.uint32)

        def row(ids: pa.Array, nodes: list, sizes: list, chunks: list, values: list, marks: list):
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([x[0] for x in nodes], pa.int64()),
                    pa.array([x[1] for x in nodes], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([part] * n, pa.int64()),
                    pa.array(chunks, pa.int32()),
                    pa.array(values, pa.binary()),
                    pa.array(marks, pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "n_shingles", "part", "key", "values", "profile"],
            )

        for batch in slices(batches):
            id_type = batch.column(0).type
            nodes, sizes, tokens = [], [], []
            for text in texts_of(batch.column(1)):
                own = shingles(text, spec.words)
                nodes.append(node_of(own))
                sizes.append(len(own))
                tokens.append(own)
            waiting += tokens
            waits += sum(sizes)
            if waits > BINS // 2:
                counts += counted(waiting)
                waiting, waits = [], 0
            none = [None] * len(sizes)
            yield row(batch.column(0), nodes, sizes, none, none, list(map(profile_of, tokens)))
        if id_type is not None:
            counts += counted(waiting)
            values = [x.tobytes() for x in np.split(counts, CHUNKS)]
            ids = pa.nulls(CHUNKS, id_type)
            none = [None] * CHUNKS
            yield row(ids, [(None, None)] * CHUNKS, none, list(range(CHUNKS)), values, none)

    return docs.mapInArrow(
        task,
        f"doc_id {kind}, k1 long, k2 long, n_shingles long, part long, key int, values binary,"
        " profile binary",
    )


def bloom(values: Column, df: DataFrame) -> np.ndarray:
    """A Bloom filter of 64-bit ``values``, two bits each: 64-bit words, at most MOST_BITS."""
    count = df.count()
    bits = 1 << 16
    while bits < min(12 * count, MOST_BITS):
        bits *= 2
    spots = df.select(
        F.explode(
            F.array(
                values.bitwiseAND(bits - 1),
                F.shiftrightunsigned(values, 32).bitwiseAND(bits - 1),
            )
        ).alias("spot")
    )
    words = (
        spots.groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bloom(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for spot in (values, values >> np.uint64(32)):
        spot = spot & np.uint64(64 * len(words) - 1)
        word = words[(spot >> np.uint64(6)).astype(np.int64)]
        out &= (word >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _index(docs: DataFrame, counts, documents: int, spec: Spec, wanted=None) -> DataFrame:
    """sig, k1, k2, n, place of every signature (that may be in ``wanted``) of every node; a task
    indexes a node once, whatever the number of its rows there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by = None
        seen: set[tuple[int, int]] = set()
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        waits = 0

        def gathered() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(c) for c in columns]
            for at in range(0, len(whole[0]), AT_ONCE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + AT_ONCE], pa.int64()) for c in whole],
                    names=["sig", "k1", "k2", "n", "place"],
                )

        for batch in slices(batches, 64):
            held_by = counts.value if held_by is None else held_by
            for text in texts_of(batch.column(1)):
                own = shingles(text, spec.words)
                node = node_of(own)
                if not len(own) or node in seen:
                    continue
                seen.add(node)
                found, places = signatures(own, held_by, documents, spec)
                if wanted is not None:
                    keep = in_bloom(wanted.value, found)
                    found, places = found[keep], places[keep]
                same = [np.full(len(found), x) for x in (*node, len(own))]
                for have, more in zip(columns, [found.view(np.int64), *same, places]):
                    have.append(more)
                waits += len(found)
                if waits >= AT_ONCE:
                    yield from gathered()
                    columns, waits = [[] for _ in range(5)], 0
        if waits:
            yield from gathered()

    return docs.mapInArrow(task, "sig long, k1 long, k2 long, n long, place long")


def _may_link(spec: Spec, n: Column, place: Column, m: Column, other: Column) -> Column:
    """Whether sizes, and the places of the first common n-gram, allow enough in common."""
    p = spec.percent
    sizes = (n * 100 >= m * p) & (m * 100 >= n * p)
    most = F.least(n - place, m - other)
    return sizes & ((place < 0) | (other < 0) | (most * (100 + p) >= (n + m) * p))


def _sets_of(docs: DataFrame, wanted, spec: Spec) -> DataFrame:
    """node and set (binary) of the rows whose node may be in ``wanted``, one row per node."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            nodes, sets = [], []
            for text in texts_of(batch.column(1)):
                own = shingles(text, spec.words)
                node = node_of(own)
                first = np.array([node[0]], np.int64).view(np.uint64)
                if len(own) and node not in seen and in_bloom(wanted.value, first)[0]:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in nodes], pa.int64()),
                    pa.array([x[1] for x in nodes], pa.int64()),
                    pa.array(sets, pa.binary()),
                ],
                names=["k1", "k2", "set"],
            )

    flat = docs.mapInArrow(task, "k1 long, k2 long, set binary")
    return flat.groupBy(_node().alias("node")).agg(F.first("set").alias("set"))


def _likely(pairs: DataFrame, profiles: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b) whose profiles allow enough in common: of each range of hashes two sets
    share no more than the smaller one has there."""
    left = profiles.select(
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("profile").alias("of_a")
    )
    right = profiles.select(
        F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("of_b")
    )
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE)
                for c in (4, 5)
            )
            low = np.minimum(x, y)
            # A full count says only that there are 255 or more.
            open_end = (low == 255).any(axis=1)
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            most = np.minimum(np.where(open_end, n, low.sum(axis=1, dtype=np.int64)), np.minimum(n, m))
            keep = 100 * most >= spec.percent * (n + m - most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = "struct<k1:bigint,k2:bigint>"
    return both.mapInArrow(task, f"a {kind}, b {kind}")


def _linked(
    pairs: DataFrame, profiles: DataFrame, docs: DataFrame, spec: Spec, files: int
) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Both joins are between tables as they were written, so Spark splits the rows of a hot node.
    What it has split is dealt out anew, not joined together, for the ``files`` of a table.
    """
    context = docs.sparkSession.sparkContext
    pairs = stage_table(_likely(pairs, profiles, spec).repartition(files), "likely-pairs")
    ends = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
    wanted = context.broadcast(bloom(F.col("a.k1"), ends))
    sets = stage_table(_sets_of(docs, wanted, spec), "sets", files=files)
    wanted.destroy()
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    kind = "struct<k1:bigint,k2:bigint>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= spec.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(task, f"a {kind}, b {kind}")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node and the least node that its edges (a, b) lead to.

    Every round each node takes the least label of its neighbours and then the label of its label;
    rounds go on until nothing changes, each written to the shared folder, in ``files`` at most.
    """
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    both = stage_table(
        pairs.union(pairs.select(F.col("next").alias("node"), F.col("node").alias("next")))
        .filter(~F.col("node").eqNullSafe(F.col("next")))
        .distinct(),
        "edges",
        files=files,
    )
    labels = stage_table(
        both.groupBy("node").agg(F.min("next").alias("least")).select(
            "node", F.least("node", "least").alias("label")
        ),
        "labels",
        files=files,
    )
    while True:
        theirs = labels.select(F.col("node").alias("next"), F.col("label").alias("theirs"))
        near = (
            look_up(both, "next", F.col("node"), theirs)
            .groupBy("node")
            .agg(F.min("theirs").alias("near"))
        )
        lower = stage_table(
            labels.join(near, "node").select(
                "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
            ),
            "labels",
            files=files,
        )
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stage_table(
            look_up(lower, "label", F.col("node"), onward, "left").select(
                "node", "was", F.coalesce("further", "label").alias("label")
            ),
            "labels",
            files=files,
        )
        labels = after.select("node", "label")
        if after.filter(~F.col("was").eqNullSafe(F.col("label"))).isEmpty():
            return labels


def join_groups(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two rows are linked if their sets have at least ``spec.percent`` hundredths of their union in
    common. component_id is the smallest doc_id that links lead to, the row's own included. Rows
    without words (null, empty, white space) have an empty set and stay alone, with their own
    doc_id. Equal texts link; rows that repeat an id with other texts are separate nodes; a null
    doc_id counts only where no other row of the group has an id. Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    docs = _task_rows(docs)
    read = stage_table(_read_sets(docs, spec), "shingle-counts")
    rows = read.filter(F.col("values").isNull()).select(
        "doc_id", _node().alias("node"), "n_shingles"
    )
    full = rows.filter(F.col("n_shingles") > 0)
    documents, ngrams = full.agg(F.count("*"), F.sum("n_shingles")).first()
    documents, ngrams = max(documents, 1), ngrams or 0
    files = max(-(-documents // DOCUMENTS_A_FILE), -(-ngrams // NGRAMS_A_FILE))
    counts = np.zeros((CHUNKS, BINS // CHUNKS), np.int64)
    counted = read.filter(F.col("values").isNotNull()).select("part", "key", "values")
    for row in sum_arrays(counted, dtype="<u4").collect():  # CHUNKS rows, 8 MB in all
        counts[row["key"]] = np.frombuffer(bytes(row["values"]), "<u4")
    # What a bin holds on average are n-grams that share it by chance.
    shared = context.broadcast(np.maximum(counts.ravel() - int(counts.mean()), 0).astype(np.uint32))

    nodes = full.groupBy("node").agg(F.min("doc_id").alias("first"))
    profiles = stage_table(
        read.filter(F.col("n_shingles") > 0)
        .groupBy(_node().alias("node"))
        .agg(F.first("n_shingles").alias("n"), F.first("profile").alias("profile")),
        "profiles",
        files=files,
    )
    met = stage_table(
        _index(docs, shared, documents, spec)
        .groupBy("sig")
        # By half of the name: missing a signature takes two sets whose halves agree by chance.
        .agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("sig"),
        "signatures",
        files=files,
    )
    wanted = context.broadcast(bloom(F.col("sig"), met))
    members = stage_table(
        _index(docs, shared, documents, spec, wanted)
        .distinct()
        .select("sig", _node().alias("node"), "n", "place"),
        "members",
        files=files,
    )
    # Both are written out, so executors need not keep them.
    wanted.destroy()
    shared.destroy()
    pivots = stage_table(
        members.groupBy("sig")
        .agg(
            F.min("node").alias("low"),
            F.max("node").alias("high"),
            F.min(F.struct("place", "node", "n")).alias("pivot"),
        )
        .filter(F.col("low") != F.col("high"))
        .select("sig", "pivot"),
        "pivots",
        files=files,
    )
    first = stage_table(
        members.join(pivots, "sig")
        .filter(
            (F.col("node") != F.col("pivot.node"))
            & _may_link(
                spec, F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place")
            )
        )
        .select(
            F.least("node", F.col("pivot.node")).alias("a"),
            F.greatest("node", F.col("pivot.node")).alias("b"),
        )
        .distinct(),
        "pairs",
        files=files,
    )
    groups = components(_linked(first, profiles, docs, spec, files), files)

    labelled = stage_table(
        members.join(groups, "node", "left").select(
            "sig", "node", "n", "place", F.coalesce("label", "node").alias("label")
        ),
        "members",
        files=files,
    )
    mixed_up = stage_table(
        labelled.groupBy("sig")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("sig"),
        "signatures",
        files=files,
    )
    rest = stage_table(labelled.join(mixed_up, "sig").repartition(files), "members")
    one, two = rest.alias("x"), rest.alias("y")
    second = stage_table(
        one.join(
            two,
            (F.col("x.sig") == F.col("y.sig"))
            & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.label") != F.col("y.label"))
            & _may_link(
                spec, F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")
            ),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti"),
        "pairs",
        files=files,
    )
    labels = groups
    if not second.isEmpty():
        edges = groups.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(edges.union(_linked(second, profiles, docs, spec, files)), files)

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    found = look_up(named, "label", F.col("node"), least).select("node", "component_id")
    return look_up(rows, "node", F.col("doc_id"), found, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id (null first), and of rows
    that repeat this id the one whose text's digest is smallest. Of rows that repeat id and text
    one stays; rows without words all stay apart from that."""
    row = F.md5(
        F.concat_ws(
            " ",
            F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
            F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")),
        ).cast("binary")
    )
    named = docs.withColumn("__row", row)
    groups = join_groups(
        named.select(F.struct("doc_id", F.col("__row").alias("row")).alias("doc_id"), "text"), spec
    )
    leaders = (
        groups.filter(F.col("doc_id") == F.col("component_id"))
        .select(F.col("doc_id.row").alias("__row"))
        .distinct()
    )
    first = Window.partitionBy("__row").orderBy(*[c for c in docs.columns if _orders(docs, c)])
    return (
        named.join(leaders, "__row")
        .withColumn("__number", F.row_number().over(first))
        .filter(F.col("__number") == 1)
        .select(docs.columns)
    )


def _orders(docs: DataFrame, column: str) -> bool:
    return not isinstance(docs.schema[column].dataType, (MapType, VariantType))
