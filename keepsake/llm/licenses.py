"""Licence scan: notices by TF-IDF cosine to templates, then inheritance from licence files.

DataFrame operations only. A notice is a line with a licence word in it; of a file named like a
licence, its whole text is one too. A header is a run of lines with a licence word in it. Words are
weighted by TF-IDF and compared with every template: short notices, standard headers and whole
licence texts. What a licence file states holds for its directory, and a file without a notice of
its own takes the licence of the nearest directory above it that has one.
"""

from __future__ import annotations

import re
from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import look_up
from keepsake.session import stage_table

# Identifiers and the wording of public licence notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the software without"
        " restriction.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and distribute this software for any purpose with or"
        " without fee is hereby granted.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
#: Licence, "program" or "library", its family's name, version.
_GNU = (
    ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-2.1", "program", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
    ("LGPL-3.0", "program", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
)
_ENDS = (
    " along with this {0}. If not, see <https://www.gnu.org/licenses/>.",
    " along with this {0}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street,"
    " Fifth Floor, Boston, MA 02110-1301 USA.",
)
_CC = (
    ("CC-BY-4.0", "Attribution", "by"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike", "by-sa"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial", "by-nc"),
)
#: Licences whose whole text lies in ``license_texts``.
TEXTS = (
    "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0"
    " MIT MPL-2.0 Unlicense".split()
)


def _headers() -> list[tuple[str, str]]:
    found = [
        (
            "Apache-2.0",
            "Licensed under the Apache License, Version 2.0 (the License); you may not use this"
            " file except in compliance with the License. You may obtain a copy of the License at"
            " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or"
            " agreed to in writing, software distributed under the License is distributed on an AS"
            " IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
            " See the License for the specific language governing permissions and limitations"
            " under the License.",
        ),
        (
            "MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
            " If a copy of the MPL was not distributed with this file, You can obtain one at"
            " https://mozilla.org/MPL/2.0/.",
        ),
        (
            "CC0-1.0",
            "To the extent possible under law, the author has dedicated all copyright and related"
            " and neighboring rights to this work to the public domain worldwide under CC0 1.0."
            " This work is distributed without any warranty.",
        ),
    ]
    for license, thing, name, version in _GNU:
        may = (
            f"This {thing} is free software: you can redistribute it and/or modify it under the"
            f" terms of the {name} as published by the Free Software Foundation;"
        )
        later = f" either version {version} of the License, or (at your option) any later version."
        hope = (
            f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY"
            " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
            f" PARTICULAR PURPOSE. See the {name} for more details. You should have received a"
            f" copy of the {name}"
        )
        for which in (later, f" version {version} of the License."):
            found.append((license, may + which))
            found += [(license, may + which + hope + end.format(thing)) for end in _ENDS]
    for license, name, short in _CC:
        found.append(
            (
                license,
                f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            )
        )
        found.append(
            (
                license,
                f"This work is licensed under the Creative Commons {name} 4.0 International"
                " License. To view a copy of this license, visit"
                f" http://creativecommons.org/licenses/{short}/4.0/ or send a letter to Creative"
                " Commons, PO Box 1866, Mountain View, CA 94042, USA.",
            )
        )
    return found


def _texts() -> list[tuple[str, str]]:
    """The whole texts as their words, all that is compared."""
    folder = package_files("keepsake.llm").joinpath("license_texts")
    texts = [(x, folder.joinpath(f"{x}.txt").read_text("utf-8")) for x in TEXTS]
    return [(x, " ".join(re.findall("[a-z0-9]+", text.lower()))) for x, text in texts]


TEMPLATES = (*NOTICES, *_headers(), *_texts())
NOTICE_WORDS = "licen[cs]e|copyright|permission|redistribut|public domain|spdx"
_BLANK = "[ \\t\\r]*+"
_BARE = "[ \\t\\r/*#;%!<>\"'.-]*+"  # no more than a comment's marks
_COMMENTS = (
    "(?im)(?:^[ \\t]*+(?://|#|\\*|/\\*|--|;|%|<!--|dnl\\b|rem\\b|\\.\\\\\")[^\\n]*+(?:\\n|\\z))++"
)
LICENCE_NAMES = "(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, license string, notice string")


def headers(files: DataFrame) -> DataFrame:
    """path, notice: runs of lines up to a blank line, up to a blank or bare comment line, and of
    comment lines alone."""
    runs = F.concat(
        F.split("text", f"\\n(?:{_BLANK}\\n)++"),
        F.split("text", f"\\n(?:{_BARE}\\n)++"),
        F.regexp_extract_all("text", F.lit(_COMMENTS), F.lit(0)),
    )
    return (
        files.filter(F.lower("text").rlike(NOTICE_WORDS))
        .select("path", F.explode(F.array_distinct(runs)).alias("notice"))
        .filter(F.lower("notice").rlike(NOTICE_WORDS))
    )


def notices(files: DataFrame) -> DataFrame:
    """path, unit (hash of the text), notice, counted: the distinct notices and headers of each
    path. Headers repeat what their lines say, so they aren't counted among the notices."""
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("notice")).filter(
        F.lower("notice").rlike(NOTICE_WORDS)
    )
    name = F.element_at(F.split("path", "/"), -1)
    whole = files.filter(name.rlike(LICENCE_NAMES) & F.lower("text").rlike(NOTICE_WORDS)).select(
        "path", F.col("text").alias("notice")
    )
    return (
        lines.union(whole)
        .withColumn("counted", F.lit(True))
        .union(headers(files).withColumn("counted", F.lit(False)))
        .groupBy("path", F.md5(F.col("notice").cast("binary")).alias("unit"))
        .agg(F.first("notice").alias("notice"), F.max("counted").alias("counted"))
    )


def similarities(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """path, license, similarity (rounded to six places): the best template of every notice or
    header.

    The inverse document frequency of a template's word is counted over all notices; a word that
    no template has counts as unseen. The templates' words are few and fixed, so they are broadcast.
    """
    spark = files.sparkSession
    found = stage_table(notices(files), "notices")
    terms = stage_table(
        found.select("path", "unit", "counted", F.explode(words_of(F.col("notice"))).alias("word"))
        .groupBy("path", "unit", "counted", "word")
        .agg(F.count("*").alias("tf")),
        "notice-words",
    )
    known = (
        template_table(spark, templates)
        .coalesce(1)
        .select("template", "license", F.explode(words_of(F.col("notice"))).alias("word"))
    )
    vocabulary = F.broadcast(known.select("word").distinct())
    total = found.agg(F.count_if("counted").alias("units"))  # one row
    idf = F.log((F.lit(1.0) + F.col("units")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    held = (
        terms.filter("counted")
        .join(vocabulary, "word")
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )
    weights = stage_table(
        known.select("word").distinct()
        .join(held, "word", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .join(F.broadcast(total))
        .select("word", idf.alias("idf")),
        "word-weights",
    )
    unseen = total.select(
        (F.log(F.lit(1.0) + F.col("units")) + F.lit(1.0)).alias("unseen")
    )
    weighted = (
        terms.join(F.broadcast(weights), "word", "left")
        .join(F.broadcast(unseen))
        .withColumn("weight", F.col("tf") * F.coalesce("idf", "unseen"))
    )
    models = (
        known.groupBy("template", "license", "word")
        .agg(F.count("*").alias("tf"))
        .join(weights, "word")
        .withColumn("model", F.col("tf") * F.col("idf"))
    )
    sizes = models.groupBy("template").agg(F.sqrt(F.sum(F.col("model") ** 2)).alias("size"))
    models = models.join(F.broadcast(sizes), "template").select(
        "template", "license", "word", (F.col("model") / F.col("size")).alias("model")
    )
    lengths = weighted.groupBy("path", "unit").agg(
        F.sqrt(F.sum(F.col("weight") ** 2)).alias("length")
    )
    products = (
        weighted.join(F.broadcast(models), "word")
        .groupBy("path", "unit", "template", "license")
        .agg(F.sum(F.col("weight") * F.col("model")).alias("product"))
    )
    return (
        products.join(lengths, ["path", "unit"])
        .select(
            "path",
            "license",
            F.round(F.col("product") / F.col("length"), 6).alias("similarity"),
        )
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
        .select("path", F.col("best.license").alias("license"), (-F.col("best.less")).alias("similarity"))
    )


def scan(
    files: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = 0.5,
) -> DataFrame:
    """Add own_license, similarity, license and inherited_from to every row of ``files``.

    ``files`` has path and text. own_license is the licence of the path's best notice or header, if
    its cosine is at least ``least`` (ties to the name that sorts first); else license is that of the
    nearest directory above with a licence file (path's own directory first, "" is the root) and
    inherited_from names this directory. Of several licence files of a directory the most similar
    notice counts. Null text has no notice; a null path is the empty path. Rows that repeat a path
    share its notices. Columns of these names are replaced. No row is lost and none is added.
    """
    kept = files.drop("own_license", "similarity", "license", "inherited_from")
    placed = kept.withColumn("path", F.coalesce(F.col("path").cast("string"), F.lit("")))
    plain = placed.select("path", F.col("text").cast("string").alias("text"))
    own = stage_table(
        similarities(plain, templates).filter(F.col("similarity") >= least), "own-licences"
    )
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    stated = (
        own.filter(F.element_at(parts, -1).rlike(LICENCE_NAMES))
        .withColumn("above", folder)
        .groupBy("above")
        .agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
        .select("above", F.col("best.license").alias("stated"))
    )
    folders = placed.select(folder.alias("folder")).distinct()
    levels = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(levels))
    above = F.transform(
        F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/")
    )
    nearest = (
        folders.select("folder", F.posexplode(above).alias("depth", "above"))
        .join(stated, "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "stated", "above")).alias("near"))
        .select("folder", F.col("near.stated").alias("stated"), F.col("near.above").alias("above"))
    )
    # One path, or one folder, may hold most rows: both are looked up with salts.
    spread = F.xxhash64(F.struct(*[c for c in placed.columns if c in ("doc_id", "text", "path")]))
    rows = look_up(
        placed.withColumn("__folder", folder),
        "path",
        spread,
        own.withColumnsRenamed({"license": "own_license"}),
        "left",
    )
    rows = look_up(rows, "__folder", spread, nearest.withColumnRenamed("folder", "__folder"), "left")
    inherits = F.col("own_license").isNull()
    return rows.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        "own_license",
        "similarity",
        F.coalesce("own_license", "stated").alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )
