"""Projects, ignore patterns and the distributed listing."""

import os

import pytest
from pyspark.sql import functions as F

from keepsake.config import DEFAULT_PATTERNS
from keepsake.functions.paths import resolve, suffix
from keepsake.functions.patterns import escaped_prefixes, excluded, glob_regex, ignored
from keepsake.operators import discovery
from keepsake.sources.inventory import listing_errors, read_inventory


def kept(spark, patterns, *paths):
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    return {r[0] for r in df.where(~ignored(F.col("rel_path"), patterns)).collect()}


@pytest.mark.parametrize(
    ("patterns", "path", "dropped"),
    [
        (DEFAULT_PATTERNS, "a/.DS_Store", True),
        (DEFAULT_PATTERNS, "._x.mov", True),
        (DEFAULT_PATTERNS, "a/x._y", False),
        (DEFAULT_PATTERNS, "@eaDir/x", True),
        (DEFAULT_PATTERNS, "#recycle/x", True),
        (DEFAULT_PATTERNS, "a/ascmhl/x.mhl", True),
        (DEFAULT_PATTERNS, "a/ascmhl", False),  # a file: the pattern is for folders
        (DEFAULT_PATTERNS, "ascmhl/x", True),
        (DEFAULT_PATTERNS, "a/.keep", False),
        ((), "ascmhl/x", True),
        (("/top.txt",), "top.txt", True),
        (("/top.txt",), "a/top.txt", False),
        (("a/b",), "a/b/c", True),
        (("a/b",), "x/a/b", False),
        (("*.md",), "x/README.md", True),
        (("*.md",), "x/README.mdx", False),
        (("cache/",), "x/cache/y", True),
        (("cache/",), "x/cache", False),
        (("a/**/z",), "a/z", True),
        (("a/**/z",), "a/b/c/z", True),
        (("**/tmp",), "q/tmp/x", True),
        (("logs/**",), "logs/a/b", True),
        (("logs/**",), "logs", False),
        (("f?o",), "foo", True),
        (("f?o",), "f/o", False),
        (("[ab].txt",), "b.txt", True),
        (("[!ab].txt",), "b.txt", False),
        (("# comment", "x"), "# comment", False),
        ((r"\#x",), "#x", True),
        ((r"\!x",), "!x", True),
        (("*.mov", "!keep.mov"), "a/keep.mov", False),
        (("*.mov", "!keep.mov"), "a/other.mov", True),
        (("!keep.mov", "*.mov"), "keep.mov", True),
        (("a/", "!a/keep.mov"), "a/keep.mov", True),  # nothing comes back below an ignored folder
        (("a/*", "!a/keep.mov"), "a/keep.mov", False),
        (("trail   ",), "trail", True),
        (("a.b",), "axb", False),
    ],
)
def test_ignore_patterns(spark, patterns, path, dropped):
    assert (path not in kept(spark, patterns, path)) is dropped


def test_globs_are_case_sensitive_on_the_name(spark):
    import fnmatch
    import re

    names = ["a.md", "A.MD", "ab", "a[b", "x-1", "x!1", "a.b.md", ""]
    for glob in ("*.md", "?b", "a[[]b", "[!a]*", "[a-z]-[0-9]", "*", "a[b"):
        pattern = re.compile(glob_regex(glob))
        for name in names:
            assert bool(pattern.match(name)) == fnmatch.fnmatchcase(name, glob), (glob, name)
    df = spark.createDataFrame([("d.md/x.mov",), ("d/x.md",)], "rel_path string")
    assert df.where(excluded(F.col("rel_path"), ["*.md"])).first()[0] == "d/x.md"


def test_escaped_prefixes():
    assert escaped_prefixes("_@#.") == ["_*", "@*", "\\#*", ".*"]
    assert escaped_prefixes("_@#.", "/mnt/_share") == ["@*", "\\#*", ".*"]


@pytest.mark.parametrize(
    ("folder", "name", "want"),
    [
        ("a/b", "c.mov", "a/b/c.mov"),
        ("", "c.mov", "c.mov"),
        ("a", "..\\x\\b.mov", "x/b.mov"),
        ("a/b", "./../c//d", "a/c/d"),
        ("a", "../../x", "../x"),
        ("a", "/abs/../y", "/y"),
        ("a", "..", "."),
    ],
)
def test_resolve(spark, folder, name, want):
    df = spark.createDataFrame([(folder, name)], "folder string, name string")
    assert df.select(resolve(F.col("folder"), F.col("name"))).first()[0] == want


def test_suffix(spark):
    from pathlib import PurePosixPath

    names = ["a.mov", "a/b.MOV", ".hidden", "x.tar.gz", "none", "a.b/c", "..x", "a b.wav"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in df.select(suffix(F.col("p"))).collect()]
    assert got == [PurePosixPath(n).suffix.lower() for n in names]


def test_discovery_depths(spark, rows):
    paths = ["2024/a/x", "2024/_b/x", "2024/note.txt", "top.txt", "@x/y/z", "2024/c/ascmhl/1.mhl",
             "ascmhl/0001.mhl", "2024/ascmhl_superseded/x/y"]
    df = spark.createDataFrame([(p, 1, "file") for p in paths],
                               "path string, size bigint, kind string")
    assert rows(discovery.discover_projects(df)) == [
        ("2024/a", "a", False),
        ("2024/c", "c", True),
    ]
    assert rows(discovery.discover_projects(df, depth=0), "rel_path") == [("2024",)]
    assert rows(discovery.stray_entries(df), "path") == [("2024/note.txt",), ("top.txt",)]
    with pytest.raises(ValueError):
        discovery.discover_projects(df, depth=-1)


def test_empty_projects_are_absent(spark, rows):
    listing = spark.createDataFrame(
        [("y/full/a", "file", None), ("y/empty/ascmhl/1.mhl", "file", None),
         ("y/broken/a", "other", "denied"), ("y/tracked/.DS_Store", "file", None)],
        "path string, kind string, error string",
    )
    contents = discovery.project_contents(listing)
    known = spark.createDataFrame([("y/tracked", "sealed")], "rel_path string, state string")
    left = discovery.drop_empty_projects(discovery.discover_projects(listing), contents, known)
    assert rows(left, "rel_path") == [("y/broken",), ("y/full",), ("y/tracked",)]


def test_inventory_of_a_real_folder(spark, tmp_path, rows):
    files = {
        "2024/p/a.mov": b"123", "2024/p/_b.mov": b"1", "2024/p/.keep": b"", "2024/p/d/e/f": b"12",
        "2024/p/@eaDir/junk": b"x", "2024/p/ascmhl/0001_x.mhl": b"<x/>", "_RES/p/x": b"x",
        "2024/note.txt": b"n",
    }
    for path, data in files.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "2024/p/a.mov", tmp_path / "2024/p/link")
    os.utime(tmp_path / "2024/p/a.mov", ns=(1, 1_700_000_000_123_456_789))
    listing = read_inventory(spark, str(tmp_path))
    assert rows(listing, "path", "kind") == [
        ("2024/note.txt", "file"),
        ("2024/p/.keep", "file"),
        ("2024/p/_b.mov", "file"),
        ("2024/p/a.mov", "file"),
        ("2024/p/ascmhl/0001_x.mhl", "file"),
        ("2024/p/d/e/f", "file"),
        ("2024/p/link", "symlink"),
    ]
    stat = listing.where("path like '%a.mov'").first()
    assert (stat.size, stat.mtime_ns) == (3, 1_700_000_000_123_456_789)
    inside = discovery.regular_files(discovery.with_project(listing))
    assert rows(discovery.apply_ignore_patterns(inside), "rel_path") == [
        (".keep",), ("_b.mov",), ("a.mov",), ("d/e/f",),
    ]


def test_unlistable_folder_is_an_error_row(spark, tmp_path, rows):
    listing = read_inventory(spark, str(tmp_path / "nowhere"))
    assert rows(listing, "path", "error") == [("", "No such file or directory")]
    assert listing_errors(listing).count() == 1


def test_nested_histories(spark, rows):
    paths = ["p/ascmhl/1.mhl", "p/sub/ascmhl/1.mhl", "p/sub/deep/ascmhl/ascmhl_chain.xml"]
    df = spark.createDataFrame([(p, "file") for p in paths], "path string, kind string")
    assert rows(discovery.nested_histories(df, depth=0)) == [("p", "sub"), ("p", "sub/deep")]


def test_effective_patterns_only_grow(spark):
    df = spark.createDataFrame([("p", ["old", "._*"]), ("q", None)],
                               "project string, latest_patterns array<string>")
    got = {r.project: r.patterns for r in
           discovery.effective_patterns(df, ["*.md", "old"]).collect()}
    assert got["p"] == ["old", "._*"] + [p for p in DEFAULT_PATTERNS if p != "._*"] + ["*.md"]
    assert got["q"] == [*DEFAULT_PATTERNS, "*.md", "old"]
    projects = spark.createDataFrame([(1,)], "last_generation_no int")
    assert discovery.removed_globs(["*.md", "*.txt"], ["*.txt"], projects).first()[1] == "*.md"


def test_emptied_projects_are_listed(spark, tmp_path, rows):
    for folder in ("2024/p", "2024/q/sub", "2024/r"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "2024/r/a.mov").write_bytes(b"x")
    listing = read_inventory(spark, str(tmp_path))
    assert rows(listing, "path", "kind") == [
        ("2024/p", "empty"), ("2024/q/sub", "empty"), ("2024/r/a.mov", "file")]
    assert rows(discovery.empty_folders(listing)) == [("2024/p",)]
    assert discovery.stray_entries(listing).count() == 0
