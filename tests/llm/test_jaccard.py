"""Long texts in the Jaccard join."""

import os
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest

from keepsake.llm import jaccard
from keepsake.session import new_folder


@pytest.mark.parametrize("percent", [50, 60, 80, 90])
@pytest.mark.parametrize("share", [1 / 3, 1.0])
def test_signatures_grow_like_the_set(percent, share):
    spec, per = jaccard.Spec(3, percent), []
    for n in (3_000, 24_000):
        own = np.sort(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        held_by = np.full(jaccard.BINS, int(share * 300), np.uint32)
        per.append(len(jaccard.signatures(own, held_by, 300, spec)[0]) / n)
    assert per[1] < 2 * per[0] + 5


@pytest.mark.parametrize("percent", [1, 30, 50, 51, 66, 80, 90, 99, 100])
def test_linkable_sizes_have_parts_in_common(percent):
    spec = jaccard.Spec(3, percent, parts=1)
    random = np.random.default_rng(5)
    for n in random.integers(1, 200_000, 300).tolist():
        most = n * 100 // percent
        for m in (n, most, int(random.integers(n, most + 1))):
            assert set(jaccard.parts_of(n, spec)) & set(jaccard.parts_of(m, spec))


def long_text(seed, n, changed=0.0):
    random = np.random.default_rng(seed)
    words = [f"w{x}" for x in np.random.default_rng(7).integers(0, 10**9, n)]
    for at in random.choice(n, int(changed * n), replace=False).tolist():
        words[at] = f"c{seed}x{at}"
    return " ".join(words)


def groups(spark, rows, spec):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard.join_groups(docs, spec).collect()}


def test_two_long_near_copies(spark):
    rows = [(1, long_text(1, 60_000)), (2, long_text(2, 57_000, 0.005))]
    assert groups(spark, rows, jaccard.Spec(5, 80)) == {1: 1, 2: 1}


def test_a_group_of_long_copies_in_some_hundred_rows(spark):
    rows = [(i, f"a text of its own number {i} x{i} y{i} z{i}") for i in range(100, 300)]
    rows += [(i, long_text(i, 12_000, 0.004 * (i % 4))) for i in range(90)]
    got = groups(spark, rows, jaccard.Spec(5, 80))
    assert got == {i: 0 if i < 90 else i for i, _ in rows}


def test_staged_tables_have_files_for_their_rows_not_for_the_partitions(
    spark, many_segments, monkeypatch
):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    monkeypatch.setattr(jaccard, "DOCUMENTS_A_FILE", 64, raising=False)
    top = os.path.dirname(urlparse(new_folder(spark, "any")).path)
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    rows = [(i, f"one text of group {i % 40} a{i % 40} b{i % 40} c{i % 40}") for i in range(120)]
    try:
        got = groups(spark, rows + [(i, f"a{i} text b{i}") for i in range(200, 208)], jaccard.Spec(2, 90))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {i: i % 40 if i < 200 else i for i in got} and len(got) == 128
    files = Counter()
    for table in set(os.listdir(top)) - before:
        if not table.startswith("shingle-counts"):  # as many as the texts were read in
            files[table] = sum(f.startswith("part-") for f in os.listdir(f"{top}/{table}"))
    assert len(files) > 5 and max(files.values()) <= 2
