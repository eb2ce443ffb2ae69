"""History files from a list of paths."""

import hashlib
import io

from pyspark.sql import functions as F

from keepsake.functions.hashing import c4_text
from keepsake.sources import histories

MANIFEST = b"""<?xml version="1.0" encoding="UTF-8"?>
<hashlist version="2.0" xmlns="urn:ASC:MHL:v2.0">
  <creatorinfo><creationdate>2024-05-01T10:00:00Z</creationdate><hostname>a &amp; b</hostname>
    <tool version="1.2">t</tool></creatorinfo>
  <processinfo><process>in-place</process>
    <roothash><content><md5>aa</md5></content><structure><md5>bb</md5></structure></roothash>
    <ignore><pattern>.DS_Store</pattern><pattern>*.tmp</pattern></ignore></processinfo>
  <hashes>
    <hash><path size="12" lastmodificationdate="2024-01-01T00:00:00Z">x/1.mov</path>
      <md5 action="original">0011</md5><xxh64 action="verified">ff</xxh64></hash>
    <directoryhash><path>x</path><content><md5>cc</md5></content><structure><md5>dd</md5></structure>
    </directoryhash>
  </hashes>
  <references><hashlistreference><path>p/ascmhl/0001.mhl</path><c4>c4zz</c4></hashlistreference></references>
</hashlist>"""


def test_every_section_of_a_manifest():
    rows = list(histories.parse_history(io.BytesIO(MANIFEST)))
    by = {}
    for r in rows:
        by.setdefault(r["section"], []).append(r)
    assert [(r["rel_path"], r["fmt"], r["digest"], r["action"], r["size"]) for r in by["file"]] == [
        ("x/1.mov", "md5", "0011", "original", 12), ("x/1.mov", "xxh64", "ff", "verified", 12)]
    assert [(r["rel_path"], r["digest"], r["structure"]) for r in by["folder"]] == [
        ("", "aa", "bb"), ("x", "cc", "dd")]
    assert by["process"][0]["patterns"] == [".DS_Store", "*.tmp"]
    assert (by["creator"][0]["hostname"], by["creator"][0]["tool_version"]) == ("a & b", "1.2")
    assert by["reference"][0]["digest"] == "c4zz" and "chain" not in by
    assert by["bytes"][0]["digest"] == c4_text(hashlib.sha512(MANIFEST).digest())


def test_chains_and_broken_files():
    chain = b"""<ascmhldirectory xmlns="urn:ASC:MHL:DIRECTORY:v2.0"><hashlist sequencenr="1">
    <path>0001_a.mhl</path><c4>c41</c4></hashlist></ascmhldirectory>"""
    assert [(r["generation_no"], r["rel_path"], r["digest"])
            for r in histories.parse_history(io.BytesIO(chain)) if r["section"] == "chain"] == [
                (1, "0001_a.mhl", "c41")]
    cut = MANIFEST[:-40]
    rows = list(histories.parse_history(io.BytesIO(cut)))
    assert [r["section"] for r in rows if r["section"] in ("error", "bytes")] == ["error", "bytes"]
    assert rows[-1]["digest"] == c4_text(hashlib.sha512(cut).digest())
    assert [r["section"] for r in histories.parse_history(io.BytesIO(b""))] == ["error", "bytes"]


def test_paths_come_from_the_listing(spark, tmp_path, rows):
    listing = spark.createDataFrame(
        [("p/ascmhl/0001_p.mhl", "file"), ("p/ascmhl/ascmhl_chain.xml", "file"), ("p/a.mhl", "file"),
         ("p/ascmhl/._0001_p.mhl", "file"), ("x.mhl", "file"), ("p/ascmhl/gone.mhl", "file"),
         ("p/ascmhl/link.mhl", "symlink")], "path string, kind string")
    found = histories.history_paths(listing)
    assert rows(found) == [("p/ascmhl/0001_p.mhl",), ("p/ascmhl/ascmhl_chain.xml",), ("p/ascmhl/gone.mhl",)]
    folder = tmp_path / "p" / "ascmhl"
    folder.mkdir(parents=True)
    (folder / "0001_p.mhl").write_bytes(MANIFEST)
    (folder / "ascmhl_chain.xml").write_bytes(b"<ascmhldirectory/>")
    read = histories.read_histories(found, str(tmp_path)).cache()
    assert rows(histories.section(read, "file"), "folder", "generation_no", "fmt") == [
        ("p", 1, "md5"), ("p", 1, "xxh64")]
    assert rows(histories.section(read, "error"), "manifest") == [("gone.mhl",)]
    assert histories.section(read, "bytes").where(F.col("manifest") == "0001_p.mhl").count() == 1
    read.unpersist()
