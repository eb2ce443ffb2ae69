"""Manifests, origin manifests, chains and tables on real files."""

import hashlib
from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from keepsake.functions.hashing import c4_text
from keepsake.sources import export, manifests, tables

NS = "{urn:ASC:MHL:v2.0}"


def exported(spark, root, inline=None, monkeypatch=None):
    if inline is not None:
        monkeypatch.setattr(export, "INLINE", inline)
    manifest = F.lit("0001_p q_2024-01-01_000000Z.mhl").alias("manifest")
    heads = spark.sql(
        "select '2024/p q+r' as project, timestamp '2024-01-01 00:00:00' as created_at,"
        " 'h' as hostname, 'tool <x>' as tool, '1' as tool_version, array('._*', 'a&b') as patterns"
    ).withColumn("manifest", manifest)
    files = spark.createDataFrame(
        [("2024/p q+r", f"d/f{i:04} <&>.mov", i, i * 10**9 + 5, fmt, d, act)
         for i in range(300) for fmt, d, act in
         (("xxh128", f"{i:032x}", "original"), ("md5", f"00{i:030x}", "verified"))],
        "project string, rel_path string, size bigint, mtime_ns bigint, fmt string, digest string,"
        " action string",
    ).withColumn("manifest", manifest)
    folders = spark.createDataFrame(
        [("2024/p q+r", "d", "xxh128", "aa", "bb"), ("2024/p q+r", "", "xxh128", "cc", "dd")],
        "project string, rel_path string, fmt string, content string, structure string",
    ).withColumn("manifest", manifest)
    lines = export.manifest_lines(heads, files, folders)
    return export.write_lines(lines, str(root)).collect()


@pytest.mark.usefixtures("many_segments")
@pytest.mark.parametrize("inline", [None, 100])
def test_manifest_round_trip(spark, tmp_path, monkeypatch, rows, inline):
    """With a tiny inline limit the parts of the manifest travel as files."""
    (written,) = exported(spark, tmp_path, inline, monkeypatch)
    path = tmp_path / written.path
    data = path.read_bytes()
    assert (written.bytes, written.c4) == (len(data), c4_text(hashlib.sha512(data).digest()))
    tree = ElementTree.fromstring(data)
    assert [c.tag.removeprefix(NS) for c in tree] == ["creatorinfo", "processinfo", "hashes"]
    hashes = tree.find(f"{NS}hashes")
    assert [c.tag.removeprefix(NS) for c in hashes] == ["hash"] * 300 + ["directoryhash"]
    assert [c.tag.removeprefix(NS) for c in hashes[0]] == ["path", "md5", "xxh128"]
    process = tree.find(f"{NS}processinfo")
    assert [c.tag.removeprefix(NS) for c in process] == ["process", "roothash", "ignore"]

    files = manifests.read_generation_files(spark, str(tmp_path))
    assert files.count() == 600
    one = files.where("rel_path = 'd/f0007 <&>.mov' and fmt = 'md5'").first()
    assert one.digest == f"00{7:030x}"  # leading zeros kept
    assert (one.size, one.action, one.generation_no) == (7, "verified", 1)
    assert one.modified_at == "1970-01-01T00:00:07.000000Z"
    assert one.folder.endswith("/2024/p q+r")
    folders = manifests.read_generation_dirs(spark, str(tmp_path))
    assert rows(folders, "rel_path", "content", "structure") == [("", "cc", "dd"), ("d", "aa", "bb")]
    head = manifests.read_generations(spark, str(tmp_path)).first()
    assert (head.tool, head.patterns, head.process) == ("tool <x>", ["._*", "a&b"], "in-place")
    assert head.created_at == datetime(2024, 1, 1)


@pytest.mark.usefixtures("many_segments")
def test_chain_round_trip(spark, tmp_path, rows):
    chain = spark.createDataFrame(
        [("p", n, f"{n:04}_p.mhl", f"c4{n}") for n in (1, 2, 10)],
        "project string, generation_no int, manifest string, c4 string",
    )
    export.write_lines(export.chain_lines(chain), str(tmp_path)).collect()
    text = (tmp_path / "p/ascmhl/ascmhl_chain.xml").read_text()
    assert text.index("0002_p") < text.index("0010_p")
    assert rows(manifests.read_chain(spark, str(tmp_path)), "generation_no", "manifest", "c4") == [
        (1, "0001_p.mhl", "c41"), (10, "0010_p.mhl", "c410"), (2, "0002_p.mhl", "c42"),
    ]


def test_origin_manifests(spark, tmp_path):
    good = (
        '<hashlist version="1.1"><creatorinfo/><hash><file>a.mov</file><size>12</size>'
        "<xxhash64be>00ff</xxhash64be><md5>AB</md5><hashdate>x</hashdate></hash>"
        "<hash><size>1</size><md5>1</md5></hash></hashlist>"
    )
    contents = {
        "p/d/_hidden.MHL": good,
        "p/ascmhl/0001.mhl": good,
        "p/d/ascmhl/0001.mhl": good,
        "p/new.mhl": '<hashlist version="2.0" xmlns="urn:ASC:MHL:v2.0"/>',
        "p/old.mhl": '<hashlist version="0.9"/>',
        "p/broken.mhl": "<hashlist",
        "p/cut.mhl": '<hashlist version="1.0"><hash><file>x</file><md5>1</md5></hash><hash>',
        "p/empty.mhl": "",
    }
    for name, text in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = spark.createDataFrame([(n.split("/")[0], n.split("/", 1)[1]) for n in contents],
                                  "project string, rel_path string")
    out = manifests.read_origin_manifests(files, str(tmp_path)).orderBy("manifest", "position")
    got = [(r.manifest, r.name, r.size, r.tag, r.value) for r in out.where("warning is null").collect()]
    assert got == [
        ("cut.mhl", "x", None, "md5", "1"),
        ("d/_hidden.MHL", "a.mov", 12, "xxhash64be", "00ff"),
        ("d/_hidden.MHL", "a.mov", 12, "md5", "AB"),
    ]
    warned = [r.warning for r in out.where("warning is not null").collect()]
    assert warned[0].startswith("cut.mhl: unreadable") and len(warned) == 2
    assert warned[1] == "_hidden.MHL: <hash> without <file>"


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    assert rows(tables.upsert(old, new, ["id"])) == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    with pytest.raises(ValueError, match="unknown columns"):
        tables.upsert(old, new.withColumnRenamed("name", "nmae"), ["id"])


def test_unknown_state_fails_the_write(spark, tmp_path):
    bad = spark.createDataFrame([("sealed",), ("molten",)], "state string")
    with pytest.raises(Exception, match="unknown state: molten"):
        tables.require_states(bad).write.parquet(str(tmp_path / "t"))


def test_replace_leaves_other_keys(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "project string, n int")
    tables.replace_rows(df, path, ["project"])
    tables.replace_rows(df.where("project = 'a'").withColumn("n", F.lit(9)), path, ["project"])
    assert rows(spark.read.parquet(path), "project", "n") == [("a", 9), ("b", 2)]


def test_a_failed_publish_is_invisible(spark, tmp_path, rows):
    store = tables.TableSet(spark, str(tmp_path / "s"))
    assert store.read("x") is None
    good = spark.createDataFrame([(1,)], "n int")
    store.publish({"x": good, "y": good})
    broken = good.withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):  # noqa: B017
        store.publish({"x": good.withColumn("n", F.lit(2)), "y": broken})
    assert rows(store.read("x")) == [(1,)]
    store.publish({"x": good.withColumn("n", F.lit(3))})
    assert rows(store.read("x")) == [(3,)] and rows(store.read("y")) == [(1,)]


def test_latest_rows(spark, rows):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)],
                                "id int, seq int, state string")
    assert rows(tables.latest_rows(log, ["id"], ["seq"])) == [(1, 3, "c"), (2, 1, None)]


def test_shared_folder_is_refused_without_a_setting(monkeypatch):
    from types import SimpleNamespace

    from keepsake.session import shared_folder

    context = SimpleNamespace(
        getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(
            SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
        )


def test_shared_folder_is_the_one_the_session_names(spark, tmp_path):
    from types import SimpleNamespace

    from keepsake.session import shared_folder

    named = []
    context = SimpleNamespace(
        getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://somewhere:7077",
        setCheckpointDir=named.append)
    conf = SimpleNamespace(get=lambda *_: "hdfs://name/folder")
    assert shared_folder(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs://name/folder"
    assert named == ["hdfs://name/folder"]


def test_a_path_without_a_scheme_is_qualified_by_spark(spark, tmp_path):
    from keepsake.session import qualified

    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
