"""The filter audit against a plain version, over several micro-batches, and the query's SQL."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType

from keepsake.llm import filter_audit, queries
from tools.check_oracle import oracle, rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc_id is not None and doc_id > least[text]}
        out.append((doc_id, part or "", {k for k, v in fails.items() if v}))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = plain_fails(rows)
    out = {}
    for part in {p for _, p, _ in found}:
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                figures = [0] * 6
                for doc_id, p, fails in found:
                    if p == part:
                        hit, gone = own in fails, bool(fails & before)
                        for k, one in enumerate((
                            not hit and not gone, hit and not gone, hit and gone, fails == {own},
                            hit and not gone and doc_id in good, hit and not gone and doc_id in toxic)):
                            figures[k] += one
                out[part, "".join(order), step] = figures
                removed_of[own] += figures[1]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_of[order[step - 1]])
    return out


def write(spark, folder, files):
    kind = "doc_id long, text string, source string, part string, mask string"
    for rows in files:
        spark.createDataFrame([(*r, "x", "x") for r in rows], kind).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_a_plain_version_over_many_batches(spark, tmp_path, seed):
    some = random.Random(seed)
    texts = [None, "", " \n", "A# x", "word " * 60, " ".join(f"w{i}" for i in range(70)),
             " ".join(f"W{i} $" for i in range(60)), "é" * 90 + " ABCDEF"]
    # Ids fall from file to file, so smaller ids keep arriving; ids and whole rows repeat.
    files = [[(some.randrange(100 - 15 * f, 120 - 15 * f), some.choice(texts), some.choice(["a", "b", None]))
              for _ in range(12)] + [(None, some.choice(texts), "a")] for f in range(6)]
    files[3] += files[1][:4]
    rows = [r for f in files for r in f]
    labels = [(i, some.choice([0, 1, None]), some.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    write(spark, str(tmp_path / "docs"), files)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, str(tmp_path / "docs"), known, files_at_once=1).collect()
    want = plain_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want
    assert len(got) == len(want) == 600 * len({p or "" for *_, p in rows})


def test_later_files_are_taken_up_where_the_stream_stood(spark, tmp_path):
    docs, counters, offsets = (str(tmp_path / x) for x in ("docs", "counters", "offsets"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")

    def counted():
        stream = spark.readStream.schema("doc_id long, text string, source string").parquet(docs)
        found = filter_audit.count_stream(stream, labels, counters, offsets).collect()
        return sorted(tuple(r) for r in found)

    write(spark, docs, [[(5, "same", "p"), (9, "same", "q")]])
    assert counted() == [("p", 1, 0, 0, 1), ("q", 17, 0, 0, 1)]
    write(spark, docs, [[(1, "same", "r"), (5, "same", "p")]])
    assert counted() == [("p", 17, 0, 0, 2), ("q", 17, 0, 0, 1), ("r", 1, 1, 0, 1)]


def test_texts_that_share_a_bucket_are_kept_apart(spark, tmp_path):
    some = random.Random(7)
    texts = [f"text {i}" for i in range(40)] + [None, ""]
    # Ids fall and rise from file to file; some are met again with the same text, some with another.
    files = [[(some.randrange(base, base + 60), some.choice(texts), some.choice("ab")) for _ in range(50)]
             for base in (200, 120, 160, 90)]
    files[2] += files[0][:10]
    files[3] += [(None, "text 1", "a"), (10, "text 2", "b")]
    docs = str(tmp_path / "docs")
    write(spark, docs, files)
    stream = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1)
    labels = spark.createDataFrame([(10, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.count_stream(
        stream.parquet(docs), labels, str(tmp_path / "counters"), str(tmp_path / "offsets"), buckets=3)
    want = Counter((part, sum(1 << "ABCDE".index(x) for x in fails), int(i == 10), int(i == 10))
                   for i, part, fails in plain_fails([r for f in files for r in f]))
    assert {tuple(r)[:4]: r.n for r in got.collect()} == want


class _Store:
    """A list state that counts its calls, and the handle that gives it."""

    def __init__(self):
        self.entries, self.calls = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return iter(list(self.entries))

    def appendValue(self, value):  # noqa: N802
        self.calls.append("append")
        self.entries.append(value)


def test_a_bucket_calls_the_state_once_however_many_texts_it_has():
    store, seen = _Store(), Counter()
    processor = filter_audit.SmallestIds(LongType())
    processor.init(store)

    def batch(ids):
        store.calls.clear()
        rows = [Row(bucket=0, key=k.to_bytes(32, "big"), doc_id=i, part="p", mask=1, good=0, toxic=0, n=1)
                for k, i in enumerate(ids)]
        found = list(processor.handleInputRows((0,), iter(rows), None))
        for r in found:
            seen[r.mask] += r.n
        return len(found), store.calls

    # Each row was counted as a duplicate (17) where it was read; its text's first is none (1).
    assert batch(range(1000, 2000)) == (2, ["get", "append"]) and seen == {1: 1000, 17: -1000}
    # Half the texts come with smaller ids, which takes the place of the earlier ones.
    assert batch([*range(500), *range(2000, 2500)]) == (0, ["get", "append"])
    assert store.entries[1][1] == list(range(500)) and seen == {1: 1000, 17: -1000}
    # Larger ids change nothing, and the last entry of a text holds.
    assert batch([*range(1, 501), *range(1501, 2001)]) == (0, ["get"])


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    write(spark, str(tmp_path / "docs"), [[]])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, str(tmp_path / "docs"), labels).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.queries()["op13_filter_audit"](spark, sf)
    names, want = oracle(sf, queries.oracle_sql()["op13_filter_audit"])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(names, want)
