"""Hard negatives against a plain version and the query's SQL."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.llm import hard_negatives, queries
from tools.check_oracle import oracle, rows_of


def plain(rows, is_anchor, positives, negatives, low, high):
    usable = [r for r in rows if None not in r[:3]]
    anchors = {}
    for r in sorted((r for r in usable if is_anchor(r[0])), key=lambda r: r[:3], reverse=True):
        anchors[r[0]] = r
    out = []
    for a in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in usable
                        if c[0] != a[0] and len(c[2]) == len(a[2]))
        same = [(i, -s) for s, i, label in scored if label == a[1]][:positives]
        for i, score in same:
            fit = [(n, -s) for s, n, label in scored
                   if label != a[1] and low * score <= -100 * s <= high * score]
            out += [(a[0], i, k, n, score, s) for k, (n, s) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    kind = "vec_id long, label int, vector array<bigint>, rank string, score string, slot string"
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], kind).repartition(5)


@pytest.mark.parametrize("block_rows", [3, 64, 32768])
def test_equals_a_plain_version(spark, block_rows):
    some = random.Random(block_rows)
    # Few distinct values, so that scores tie; all signs of scores occur.
    rows = [(i, some.randrange(3), [some.randrange(-2, 4) for _ in range(4)]) for i in range(150)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, 7, 30, 90, block_rows)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, 5, 7, 30, 90)


def test_nulls_repeats_lengths_and_large_numbers(spark):
    some = random.Random(1)
    rows = [(i, i % 2, [some.randrange(-5, 9) for _ in range(3)]) for i in range(40)]
    rows += [(None, 1, [1, 1, 1]), (7, None, [1, 1, 1]), (8, 1, None), (9, 1, [1]), (10, 0, [2]),
             (11, 0, []), (12, 1, [])]
    rows += [(500 + i, i % 2, [(3 << 26) + i, 1 << 25, -i]) for i in range(6)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 4 == 0, 2, 3)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 4 == 0, 2, 3, 30, 90)
    doubled = rows[:20] + [(0, 1, [9, 9, 9])]
    got = hard_negatives.mine(frame(spark, doubled), F.col("vec_id") == 0, 5, 10)
    assert {r.anchor_id for r in got.collect()} <= {0}


def test_without_anchors_or_rows(spark):
    rows = [(1, 1, [1, 2]), (2, 1, [1, 2]), (3, 2, [1, 2])]
    assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") > 5).count() == 0
    assert hard_negatives.mine(frame(spark, rows).limit(0), F.lit(True)).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.queries()["op12_hard_negatives"](spark, sf)
    names, want = oracle(sf, queries.oracle_sql()["op12_hard_negatives"])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) > 100 and got == rows_of(names, want)
