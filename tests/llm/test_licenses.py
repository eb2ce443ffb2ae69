"""Licences of real headers and licence files whose words are not a template's."""

import textwrap

from keepsake.llm import licenses

GNU = """Copyright (C) 2019 Jane Doe and others

This file is part of Frobnicate.

{who} is free software; you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.

{who} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with {who}.  If not, see <http://www.gnu.org/licenses/>."""
GNUS = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"),
        "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
APACHE = """Copyright 2014 The Frobnicate Authors

Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy
of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def comment(text, mark):
    if mark == "/*":
        return "/*\n" + textwrap.indent(text, " * ", lambda _: True) + "\n */\n"
    return textwrap.indent(text, mark + " ", lambda _: True) + "\n"


def got(spark, rows):
    files = spark.createDataFrame(rows, "path string, text string")
    return {r.path: (r.own_license, r.license) for r in licenses.scan(files).collect()}


def headers():
    for name, (kind, version) in GNUS.items():
        for who in ("This program", "Frobnicate"):
            yield name, GNU.format(who=who, kind=kind, version=version)
    yield "Apache-2.0", APACHE


def test_wrapped_headers(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(headers()):
        for k, mark in enumerate(("/*", "#", "//", "--", ";")):
            path = f"src/{i}/{k}"
            rows.append((path, comment(text, mark) + "import os\nx = 1\ny = f(x)\n\nmore = 2\n"))
            want[path] = name, name
    rows.append(("src/LICENSE", "Released under the MIT License."))
    rows.append(("src/plain", "import os\n# nothing said here\n"))
    assert got(spark, rows) == want | {"src/LICENSE": ("MIT", "MIT"), "src/plain": (None, "MIT")}


def test_whole_licence_files(spark):
    rows, want = [], {}
    for name in licenses.TEXTS:
        text = (licenses.package_files("keepsake.llm") / f"license_texts/{name}.txt").read_text()
        lines = text.replace("<year>", "1999-2024").replace("<owner>", "Acme Widgets Ltd").split("\n")
        changed = {
            "own": "Frobnicate, by Jane Doe <jane@example.org>\n\n" + "\n".join(lines) + "\nThanks!\n",
            "cut": "\n".join(lines[: max(len(lines) * 9 // 10, 12)]),
            "joined": " ".join("\n".join(lines).split()),
        }
        for kind, text in changed.items():
            rows += [(f"{name}/{kind}/LICENSE.txt", text), (f"{name}/{kind}/a/b.c", "int x;")]
            want |= {f"{name}/{kind}/LICENSE.txt": (name, name), f"{name}/{kind}/a/b.c": (None, name)}
    assert got(spark, rows) == want
