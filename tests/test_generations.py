"""Actions, history diff, references and copies."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import generations

NEW = "project string, rel_path string, fmt string, digest string"


def new(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], NEW)


def history(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], NEW + ", generation_no int")


def test_actions(spark, rows):
    past = history(
        spark,
        ("known", "md5", "1", 1),
        ("known", "md5", "2", 2),  # the first digest counts, not the last
        ("other", "md5", "1", 1),
        ("narrow", "sha1", "1", 1),
    )
    given = new(
        spark,
        ("known", "md5", "1"),
        ("known", "xxh128", "7"),
        ("other", "md5", "2"),
        ("other", "xxh128", "7"),
        ("narrow", "md5", "1"),
        ("fresh", "xxh128", "7"),
        ("fresh", "md5", "1"),
        ("alone", "md5", "1"),
    )
    out = generations.assign_actions(given, past, ["md5"])
    assert rows(out, "rel_path", "fmt", "action", "problem") == [
        ("alone", "md5", "verified", "at least one format must be original"),
        ("fresh", "md5", "verified", None),
        ("fresh", "xxh128", "original", None),
        ("known", "md5", "verified", None),
        ("known", "xxh128", "verified", None),
        ("narrow", "md5", "failed", "none of the recorded formats was given"),
        ("other", "md5", "failed", "hash mismatch"),
        ("other", "xxh128", "failed", "hash mismatch"),
    ]


def test_failed_entries_are_no_reference(spark):
    past = history(spark, ("f", "md5", "bad", 1), ("f", "md5", "good", 2)).withColumn(
        "action", F.when(F.col("generation_no") == 1, "failed").otherwise("original")
    )
    out = generations.assign_actions(new(spark, ("f", "md5", "good")), past)
    assert out.first().action == "verified"


def test_completeness(spark):
    given = new(spark, ("a", "md5", "1"), ("b", "sha1", "1"))
    present = new(spark, ("a", "", ""), ("c", "", ""))
    recorded = new(spark, ("a", "", ""), ("d", "", ""))
    actions = given.withColumn("problem", F.when(F.col("rel_path") == "a", "hash mismatch"))
    got = generations.completeness_check(given, present, recorded, actions, "md5").first().asDict()
    assert got == {"project": "p", "without_digest": 1, "not_on_disk": 1, "gone": 1,
                   "lacks_format": 1, "failures": 1, "complete": False}
    fine = generations.completeness_check(
        given.where("rel_path = 'a'"), present.where("rel_path = 'a'"), recorded.limit(0),
        actions.limit(0), "md5",
    )
    assert fine.first().complete


def replay(gens, entries):
    """The history one generation at a time."""
    known, out = {}, []
    for n, (number, full) in enumerate(gens):
        listed = entries.get(number, {})
        if n:
            fresh = sum(p not in known for p in listed)
            changed = sum(
                p in known and any(known[p].get(f, d) != d for f, d in ds.items())
                for p, ds in listed.items()
            )
            gone = sum(p not in listed for p in known) if full else 0
            out.append((number, len(listed), fresh, changed, gone))
        if full:
            known = {}
        known.update(listed)
    return out, known


@pytest.mark.usefixtures("many_segments")
@pytest.mark.parametrize("seed", range(5))
def test_history_diff_equals_a_replay(spark, rows, seed):
    pick = random.Random(seed)
    gens = [(n, pick.random() < 0.5) for n in range(1, 12)]
    entries = {
        n: {f"f{pick.randrange(8)}": {f: str(pick.randrange(3)) for f in
                                      pick.sample(["md5", "sha1"], pick.randint(1, 2))}
            for _ in range(pick.randrange(7))}
        for n, _ in gens if pick.random() < 0.9
    }
    table = spark.createDataFrame([("p", *g) for g in gens],
                                  "project string, generation_no int, is_full boolean")
    long = spark.createDataFrame(
        [("p", n, p, f, d) for n, files in entries.items() for p, ds in files.items()
         for f, d in ds.items()],
        "project string, generation_no int, rel_path string, fmt string, digest string",
    )
    want, known = replay(gens, entries)
    got = generations.history_diff(table, long)
    assert [tuple(r) for r in got.orderBy("generation_no").select(
        "generation_no", "files", "new", "modified", "removed").collect()] == want
    state = generations.current_from_history(table, long)
    assert {r.rel_path for r in state.collect()} == set(known)


def test_changes_text(spark):
    df = spark.createDataFrame([(12, 1, 2), (0, 0, 0), (0, 3, 0)],
                               "new bigint, modified bigint, removed bigint")
    assert [r[0] for r in df.select(generations.changes_text()).collect()] == [
        "+12 new · 1 modified · 2 removed", "no changes", "3 modified",
    ]


def test_numbering(spark):
    pending = spark.sql("select '2024/my proj' as project, timestamp '2024-03-05 06:07:08' created_at")
    chain = spark.sql("select '2024/my proj' as project, 41 as generation_no")
    got = generations.number_generations(pending, chain).first()
    assert (got.generation_no, got.manifest) == (42, "0042_my proj_2024-03-05_060708Z.mhl")
    first = generations.number_generations(pending, chain.limit(0)).first()
    assert first.manifest.startswith("0001_")


def test_orphans(spark, rows):
    listing = spark.createDataFrame(
        [("p", f"ascmhl/{n}") for n in ("0001_a.mhl", "0002_a.mhl", "._0003_a.mhl", "x.txt")]
        + [("p", "sub/ascmhl/0009.mhl")], "project string, rel_path string")
    chain = spark.createDataFrame([("p", "0001_a.mhl")], "project string, manifest string")
    assert rows(generations.orphan_manifests(listing, chain)) == [("p", "0002_a.mhl")]


def test_references_need_renewal(spark):
    two = spark.createDataFrame([("a",), ("b",)], "rel_path string")
    one = two.limit(1)

    def needed(now, before, flag=False, has_root=True):
        return generations.references_stale(now, before, flag, has_root).first().needed

    assert not needed(two, two)
    assert needed(two, one) and needed(one, two)
    assert needed(two, two, flag=True) and needed(two, two, has_root=False)
    assert not needed(two.limit(0), two, flag=True)


def test_sync_sets_a_foreign_copy_aside(spark, rows):
    stored = spark.createDataFrame(
        [("p", "1.mhl", "a", 1, False), ("p", "ascmhl_chain.xml", "old", 1, False),
         ("q", "1.mhl", "b", 2, False), ("q", "x.mhl", "c", 2, False), ("q", "0.mhl", "z", 1, True),
         ("r", "1.mhl", "r", 1, False)],
        "project string, name string, content_id string, epoch int, superseded boolean",
    )
    source = spark.createDataFrame(
        [("p", "1.mhl", "changed"), ("p", "2.mhl", "n"), ("p", "ascmhl_chain.xml", "new"),
         ("p", ".2.mhl.tmp", "t"), ("q", "1.mhl", "b"), ("n", "1.mhl", "n")],
        "project string, name string, content_id string",
    )
    out = generations.sync_history(stored, source)
    assert rows(out) == sorted([
        ("p", "1.mhl", "a", 1, False),  # manifests never change
        ("p", "2.mhl", "n", 1, False),
        ("p", "ascmhl_chain.xml", "new", 1, False),
        ("q", "0.mhl", "z", 1, True),
        ("q", "1.mhl", "b", 2, True),
        ("q", "x.mhl", "c", 2, True),
        ("q", "1.mhl", "b", 3, False),
        ("r", "1.mhl", "r", 1, False),  # no source: the copy stays
        ("n", "1.mhl", "n", 1, False),
    ], key=repr)
