"""Sealing from bytes to manifests: dies anywhere, goes on, publishes once."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from keepsake.functions.hashing import c4_text
from keepsake.operators import discovery, rollup
from keepsake.plans import seal_queries, whole_seal
from keepsake.plans.fixtures import Fixtures
from keepsake.plans.whole_seal import Maker, latest, seal_archive
from keepsake.sources import export, inventory
from keepsake.sources.tables import TableSet


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as out:
            out.write(text)


def lister(spark, root, tamper=None):
    calls = []

    def files():
        calls.append(1)
        if tamper and len(calls) == 2:
            tamper()
        listing = inventory.read_inventory(spark, root, depth=0)
        inside = discovery.apply_ignore_patterns(discovery.with_project(listing, depth=0))
        return discovery.regular_files(inside)

    return files


def seal(spark, root, store, run="r1", tamper=None, primary="md5", **more):
    return seal_archive(
        spark, root, lister(spark, root, tamper), store, f"{store.path}/manifests", run,
        F.lit("2024-05-01 10:00:00").cast("timestamp"),
        Maker("host"), primary=primary, **more)


def states(df):
    return {r.project: (r.state, r.generation_no) for r in df.collect()}


FILES = {"a/x/1.mov": "one", "a/x/2.mov": "two", "a/3.mov": "three", "b/y/1.mov": "four"}


def test_a_run_that_dies_goes_on_and_publishes_once(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "archive"), TableSet(spark, str(tmp_path / "store"))
    put(root, FILES)

    def die(*_, **__):
        raise RuntimeError("killed")

    places = ((whole_seal, "_read"), (rollup, "directory_hashes"), (export, "manifest_lines"),
              (TableSet, "publish"))
    for owner, where in places:
        with monkeypatch.context() as m:
            m.setattr(owner, where, die)
            with pytest.raises(RuntimeError, match="killed"):
                seal(spark, root, store)
        assert store.read_all("outcome") is None
        if where == "directory_hashes":
            # The bytes were read before the run died; they are not read again.
            path = os.path.join(root, "a/3.mov")
            stat = os.stat(path)
            put(root, {"a/3.mov": "THREE"})
            os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert states(seal(spark, root, store)) == {"a": ("sealed", 1), "b": ("sealed", 1)}
    entries = {(r.project, r.rel_path): r.digest for r in store.read_all("entries").collect()}
    assert entries == {tuple(p.split("/", 1)): hashlib.md5(t.encode()).hexdigest() for p, t in FILES.items()}
    before = store._pointer().count()
    assert states(seal(spark, root, store)) == {"a": ("sealed", 1), "b": ("sealed", 1)}
    assert store._pointer().count() == before
    for r in store.read_all("chain").collect():
        with open(f"{store.path}/manifests/{r.project}/ascmhl/{r.manifest}", "rb") as f:
            data = f.read()
        assert (r.bytes, r.c4) == (len(data), c4_text(hashlib.sha512(data).digest()))


def test_sealed_onto_its_history(spark, tmp_path):
    root, store = str(tmp_path / "archive"), TableSet(spark, str(tmp_path / "store"))
    put(root, FILES)
    seal(spark, root, store, "r1")
    put(root, {"a/new.mov": "new", "b/y/1.mov": "FOUR!"})
    put(root, {"c/1.mov": "five"})
    out = seal(spark, root, store, "r2")
    assert states(out) == {"a": ("sealed", 2), "b": ("needs_review", None), "c": ("sealed", 1)}
    of_a = store.read_all("entries").where("project = 'a' and generation_no = 2")
    assert {(r.rel_path, r.action) for r in of_a.collect()} == {
        ("x/1.mov", "verified"), ("x/2.mov", "verified"), ("3.mov", "verified"), ("new.mov", "original")}
    record = {(r.project, r.rel_path): r.digest for r in latest(store, "sealed").collect()}
    assert record["b", "y/1.mov"] == hashlib.md5(b"four").hexdigest() and len(record) == 6
    assert {(r.project, r.generation_no) for r in store.read_all("chain").collect()} == {
        ("a", 1), ("a", 2), ("b", 1), ("c", 1)}
    with open(f"{store.path}/manifests/a/ascmhl/ascmhl_chain.xml") as f:
        assert f.read().count("<hashlist sequencenr") == 2
    assert {(r.id, r.work_state) for r in store.read_all("work").where("run = 'r2'").collect()} == {
        ("a", "done"), ("b", "done"), ("c", "done")}


def test_a_project_that_changes_while_it_is_read_ends_in_error(spark, tmp_path):
    root, store = str(tmp_path / "archive"), TableSet(spark, str(tmp_path / "store"))
    put(root, FILES)
    out = seal(spark, root, store, tamper=lambda: put(root, {"b/y/1.mov": "longer than before"}))
    assert states(out) == {"a": ("sealed", 1), "b": ("error", None)}
    assert {r.project for r in store.read_all("entries").select("project").collect()} == {"a"}
    assert states(seal(spark, root, store, "r2")) == {"a": ("sealed", 2), "b": ("sealed", 1)}


def test_origin_digests_that_differ_go_to_review(spark, tmp_path):
    root, store = str(tmp_path / "archive"), TableSet(spark, str(tmp_path / "store"))
    put(root, FILES)
    rows = [("a", "3.mov", "md5", hashlib.md5(b"three").hexdigest()), ("b", "y/1.mov", "md5", "0" * 32)]
    expected = spark.createDataFrame(rows, "project string, rel_path string, fmt string, digest string")
    out = seal(spark, root, store, expected=expected, primary="xxh128")
    assert states(out) == {"a": ("sealed", 1), "b": ("needs_review", None)}


def test_the_second_state_replaces_only_what_changed(spark, tmp_path):
    """Every other file keeps its bytes in place and gets a new mtime, so it is read again."""
    rows = [(i, f"text {i}", "en", f"src{i % 4}") for i in range(70)]
    rows += [(98, None, "en", "src0"), (5, "text 5", "en", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "data/documents.parquet"))
    fx, root = Fixtures(spark, str(tmp_path / "data")), str(tmp_path / "archive")

    def found():
        out = {}
        for at, _, names in os.walk(root):
            for name in names:
                path = os.path.join(at, name)
                with open(path, "rb") as f:
                    out[os.path.relpath(path, root)] = (os.stat(path), f.read())
        return out

    def wanted(number):
        states = spark.sql(
            f"with {seal_queries.STATES} select concat(project, '/', rel_path), text from states"
            f" where run_no = {number}").collect()
        return {path: text.encode() for path, text in states}

    seal_queries._write(fx, root, 1)
    first = found()
    assert {p: data for p, (_, data) in first.items()} == wanted(1)
    seal_queries._write(fx, root, 2)
    second = found()
    assert {p: data for p, (_, data) in second.items()} == wanted(2)
    over = {p for p in first if first[p][1] != second[p][1]}
    assert over == {"src0/en/36.mov", "src0/en/98.wav", "src3/en/5.EXR", "src3/en/67"}
    for path in first.keys() - over:
        assert first[path][0].st_ino == second[path][0].st_ino
        assert first[path][0].st_mtime_ns < second[path][0].st_mtime_ns


def test_few_folders_are_listed_by_many_tasks(spark, tmp_path):
    put(str(tmp_path), {f"p{i}/{n}.mov": "x" for i in range(9) for n in range(3)})
    listing = inventory.read_inventory(spark, str(tmp_path), depth=0)
    assert listing.where("kind = 'file'").count() == 27
    assert listing.rdd.getNumPartitions() >= 9
