"""Digests, roll-ups and origin reconciliation against plain Python."""

import hashlib
import os

import pytest
import xxhash
from pyspark.sql import functions as F

from keepsake.functions.hashing import c4_text, digest
from keepsake.operators import digests, origin, rollup

PLAIN = {
    "xxh128": lambda b: xxhash.xxh128(b).hexdigest(),
    "xxh64": lambda b: xxhash.xxh64(b).hexdigest(),
    "xxh3": lambda b: xxhash.xxh3_64(b).hexdigest(),
    "md5": lambda b: hashlib.md5(b).hexdigest(),
    "sha1": lambda b: hashlib.sha1(b).hexdigest(),
}


@pytest.mark.parametrize("fmt", sorted(PLAIN))
def test_digest_columns(spark, fmt):
    data = [b"", b"abc", bytes(range(256)) * 9]
    df = spark.createDataFrame([(d,) for d in data], "content binary")
    got = [r[0] for r in df.select(digest(F.col("content"), fmt)).collect()]
    assert got == [PLAIN[fmt](d) for d in data]


def test_c4_of_known_bytes():
    """The published identifier of the empty input."""
    empty = c4_text(hashlib.sha512(b"").digest())
    assert empty == (
        "c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT"
    )
    assert len(c4_text(b"\0" * 64)) == 90


def test_unknown_format_is_rejected(spark):
    df = spark.createDataFrame([("p", "a", 1, 1)],
                               "project string, rel_path string, size bigint, mtime_ns bigint")
    with pytest.raises(ValueError):
        digests.compute_digests(df, "/nowhere", formats=["crc32"])


def test_compute_digests_reads_files_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "OPEN_BYTES", 0)
    data = {"a.mov": b"1" * 1000, "_b.mov": b"", ".keep": b"x", "sub/d e+f.wav": b"y" * 10}
    for name, content in data.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    files = spark.createDataFrame(
        [("p", n, len(c), os.stat(tmp_path / "p" / n).st_mtime_ns) for n, c in data.items()]
        + [("p", "gone", 1, 1)],
        "project string, rel_path string, size bigint, mtime_ns bigint",
    )
    out = digests.compute_digests(files, str(tmp_path), formats=sorted(PLAIN), bucket_bytes=500)
    got = {(r.rel_path, r.fmt): r.digest for r in out.where("status = 'ok'").collect()}
    assert got == {(n, f): PLAIN[f](c) for n, c in data.items() for f in PLAIN}
    bad = out.where("status <> 'ok'").select("rel_path", "status", "error").distinct().collect()
    assert [tuple(r) for r in bad] == [("gone", "error", "No such file or directory")]


def test_a_file_that_keeps_changing(tmp_path, monkeypatch):
    path = tmp_path / "f"
    path.write_bytes(b"abc")
    ticks = iter(range(100))
    monkeypatch.setattr(digests, "stat_of", lambda _: (3, next(ticks)))
    assert digests.read_once(str(path), ["md5"])[0] == "changed"


@pytest.mark.usefixtures("many_segments")
def test_buckets_hold_about_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(digests, "OPEN_BYTES", 0)
    files = spark.range(1000).select(
        F.lit("p").alias("project"), F.lpad(F.col("id").cast("string"), 4, "0").alias("rel_path"),
        F.when(F.col("id") == 7, 10_000).otherwise(10).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("mtime_ns"),
    )
    placed = digests.balance_by_bytes(files, bucket_bytes=1000)
    sums = {r[0]: r[1] for r in placed.groupBy("bucket").sum("size").collect()}
    assert sum(sums.values()) == 19_990
    assert sorted(sums.values())[-2] <= 1000 and max(sums.values()) <= 11_000


def test_reuse_needs_the_exact_stat(spark, rows):
    files = spark.createDataFrame(
        [("p", "same", 1, 1), ("p", "nudged", 1, 2), ("p", "new", 1, 1)],
        "project string, rel_path string, size bigint, mtime_ns bigint",
    )
    origin_rows = spark.createDataFrame(
        [("p", "same", "md5"), ("p", "same", "crc"), ("p", "absent", "md5")],
        "project string, rel_path string, fmt string",
    )
    stored = spark.createDataFrame(
        [("p", n, 1, 1, "xxh128", n[0]) for n in ("same", "nudged")],
        "project string, rel_path string, size bigint, mtime_ns bigint, fmt string, digest string",
    )
    wanted = digests.wanted_formats(files, origin_rows)
    reused = digests.reuse_digests(wanted, stored)
    assert rows(reused.where("digest is not null"), "rel_path", "fmt") == [("same", "xxh128")]
    todo = digests.to_compute(reused)
    assert rows(todo, "rel_path", "formats") == [
        ("new", ["xxh128"]), ("nudged", ["xxh128"]), ("same", ["md5"]),
    ]
    fresh = digests.fresh_read(wanted)
    assert rows(fresh.where("rel_path = 'same'"), "formats") == [(["md5", "xxh128"],)]


def folder_hashes(files, fmt, folder=""):
    """The recursive definition."""
    plain = PLAIN[fmt]
    inside = {p[len(folder):]: d for p, d in files.items() if p.startswith(folder)}
    contents, structures, out = [], [], {}
    for name in {p.split("/")[0] for p in inside}:
        if name in inside:
            content = structure = inside[name]
        else:
            found = folder_hashes(files, fmt, f"{folder}{name}/")
            out |= found
            content, structure = found[f"{folder}{name}"]
        contents.append(content)
        structures.append(plain(name.encode() + bytes.fromhex(structure)))
    out[folder.rstrip("/")] = (
        plain(b"".join(map(bytes.fromhex, sorted(contents)))),
        plain(b"".join(map(bytes.fromhex, sorted(structures)))),
    )
    return out


@pytest.mark.usefixtures("many_segments")
@pytest.mark.parametrize(("fmt", "small"), [("md5", 10_000), ("xxh128", 10_000), ("xxh128", 5),
                                            ("md5", 5)])
def test_directory_hashes(spark, fmt, small):
    """With ``small`` = 5 the crowded folder takes the path for any number of children."""
    files = {f"a/b{i % 3}/c{i % 2}/f{i}": f"{i}" for i in range(20)}
    files |= {f"flat/f{i}": "copy" if i % 3 else f"{i}" for i in range(1500)}
    files |= {"top": "t", "á/ñ": "n"}
    digested = {p: PLAIN[fmt](v.encode()) for p, v in files.items()}
    df = spark.createDataFrame([("p", p, d) for p, d in digested.items()],
                               "project string, rel_path string, digest string")
    got = {
        r.rel_path: (r.content, r.structure)
        for r in rollup.directory_hashes(df, fmt, small_folder=small).collect()
    }
    assert got == folder_hashes(digested, fmt)


def test_content_survives_a_rename_and_structure_does_not(spark):
    one = spark.createDataFrame([("p", "a", "00" * 16)],
                                "project string, rel_path string, digest string")
    two = one.withColumn("rel_path", F.lit("b"))
    first = rollup.directory_hashes(one, "md5").first()
    second = rollup.directory_hashes(two, "md5").first()
    assert first.content == second.content and first.structure != second.structure


ENTRY = (
    "project string, manifest string, position bigint, name string, tag string, value string"
)


def entries(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], ENTRY)


def test_normalise_origin(spark, rows):
    out = origin.normalise_origin(entries(
        spark,
        ("d/m.mhl", 0, "a.mov", "md5", " ABCDEF "),
        ("d/m.mhl", 1, "a.mov", "xxhash64", "0123456789abcdef"),
        ("d/m.mhl", 2, "a.mov", "xxhash64be", "0123456789ABCDEF"),
        ("d/m.mhl", 3, "a.mov", "xxhash64", "xyz"),
        ("d/m.mhl", 4, "..\\x\\b.mov", "sha1", "00"),
        ("d/m.mhl", 5, "a.mov", "xxhash", "123"),
        ("d/m.mhl", 6, "a.mov", "null", ""),
    ))
    assert [tuple(r) for r in out.orderBy("position").select("rel_path", "fmt", "digest").collect()
            ] == [
        ("d/a.mov", "md5", "abcdef"),
        ("d/a.mov", "xxh64", "efcdab8967452301"),
        ("d/a.mov", "xxh64", "0123456789abcdef"),
        ("d/a.mov", None, None),
        ("x/b.mov", "sha1", "00"),
        ("d/a.mov", None, None),
        ("d/a.mov", None, None),
    ]
    warned = [r.warning for r in out.orderBy("position").collect() if r.warning]
    assert warned == [
        "m.mhl: d/a.mov: invalid xxhash64 value",
        "m.mhl: d/a.mov: XXH32 (xxhash) has no equivalent, skipped",
    ]


def test_first_value_in_walk_order_wins(spark, rows):
    out = origin.merge_origin(origin.normalise_origin(entries(
        spark,
        ("d/m.mhl", 0, "a", "md5", "03"),
        ("z.mhl", 1, "d/a", "md5", "02"),
        ("z.mhl", 0, "d/a", "md5", "01"),
        ("z.mhl", 2, "d/a", "md5", "01"),
        ("d/sub/m.mhl", 0, "../a", "md5", "04"),
    )))
    assert rows(out, "rel_path", "fmt", "digest", "conflicts") == [("d/a", "md5", "01", 3)]


def test_origin_problems(spark, rows):
    expected = spark.createDataFrame(
        [("p", "ok", "md5", "1"), ("p", "bad", "md5", "1"), ("p", "gone", "md5", "1"),
         ("p", "unread", "md5", "1"), ("p", "other", "sha1", "1"), ("p", "hidden", "md5", "1")],
        "project string, rel_path string, fmt string, digest string",
    )
    present = spark.createDataFrame(
        [("p", n, 1, 1) for n in ("ok", "bad", "unread", "other")],
        "project string, rel_path string, size bigint, mtime_ns bigint",
    )
    read = spark.createDataFrame(
        [("p", "ok", "md5", "1"), ("p", "bad", "md5", "2"), ("p", "bad", "xxh128", "9"),
         ("p", "other", "md5", "1")],
        "project string, rel_path string, fmt string, digest string",
    )
    hidden = spark.createDataFrame([("p", "hidden")], "project string, rel_path string")
    out = origin.origin_problems(expected, present, read, hidden)
    assert rows(out, "rel_path", "change") == [
        ("bad", "modified"), ("gone", "deleted"), ("other", "modified"),
    ]
    kept = origin.accept_overrides(read, out)
    assert rows(kept, "rel_path", "fmt") == [("bad", "xxh128"), ("ok", "md5")]


@pytest.mark.usefixtures("many_segments")
def test_waves_resume_where_a_run_died(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(digests, "OPEN_BYTES", 0)
    from keepsake.sources.tables import append_rows

    for n in range(12):
        path = tmp_path / "a" / "p" / f"f{n:02}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    files = spark.createDataFrame(
        [("p", f"f{n:02}", n, os.stat(tmp_path / "a/p" / f"f{n:02}").st_mtime_ns) for n in range(12)],
        "project string, rel_path string, size bigint, mtime_ns bigint",
    )
    wanted = files.withColumn("fmt", F.lit("xxh128"))
    store, root = str(tmp_path / "digests"), str(tmp_path / "a")
    calls = []

    def dies_after_one(wave):
        if calls:
            raise RuntimeError("executor lost")
        calls.append(1)
        append_rows(wave, store)

    with pytest.raises(RuntimeError):
        digests.read_in_waves(wanted, None, root, dies_after_one, bucket_bytes=10, wave_buckets=2)
    done = spark.read.parquet(store).count()
    assert 0 < done < 12
    stored = spark.read.parquet(store)
    digests.read_in_waves(wanted, stored, root, lambda w: append_rows(w, store), bucket_bytes=10)
    got = {r.rel_path: r.digest for r in spark.read.parquet(store).collect()}
    assert got == {f"f{n:02}": PLAIN["xxh128"](b"x" * n) for n in range(12)}
    assert spark.read.parquet(store).count() == 12
    everything = spark.read.parquet(store)
    assert digests.read_in_waves(wanted, everything, root, lambda w: append_rows(w, store)) == 0
