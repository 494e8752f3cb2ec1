"""Licences of files: headers and licence files by sparse TF-IDF cosine, then the nearest licence file above.

What is compared are units: paragraphs, which are runs of lines with a letter or
digit, so that a header wrapped over comment lines is one unit; their single
lines; and, of a file that is named as a licence, its whole text.  A unit with a
word that licences use, and any paragraph of a licence file, becomes a sparse
vector of its words, as do the templates: notices, headers, titles and whole
licences.  A unit takes the licence of the nearest template if the cosine reaches
a limit.  A file without such a unit takes the licence of the licence file in the
nearest directory on its way up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import cut, ready, small

# Texts of licences and of the notices, headers and titles that name them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions:"
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the "
    "License, or (at your option) any later version."
)
_GPL_TITLE = "GNU {}GENERAL PUBLIC LICENSE Version {}"
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", _MIT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", f"MIT License Copyright (c) {_MIT} {_MIT_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format("", 3)),
    ("GPL-3.0", _GPL_TITLE.format("", "3, 29 June 2007")),
    ("GPL-3.0", _GPL_TITLE.format("", "3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format("", 2)),
    ("GPL-2.0", _GPL_TITLE.format("", "2, June 1991")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GPL.format("Lesser ", 3)),
    ("LGPL-3.0", _GPL_TITLE.format("LESSER ", "3, 29 June 2007")),
    ("AGPL-3.0", _GPL.format("Affero ", 3)),
    ("AGPL-3.0", _GPL_TITLE.format("AFFERO ", "3, 19 November 2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} 1. {_BSD_TWO} 3. {_BSD_THIRD} {_BSD_END}"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} 1. {_BSD_TWO} {_BSD_END}"),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("proprietary", "Copyright. All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-3.0-only", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC")),
)
#: Every template holds one of these.
CUE = r"(?i)licen[sc]e|copyright|permission|redistribut|released|all rights reserved"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.\-].*)?$"
#: Line ends with the signs around them, such as those that mark comments.
LINE_END, PARAGRAPH_END = r"[^A-Za-z0-9\n]*\n[^A-Za-z0-9\n]*", r"\n\n+"
LEAST = 0.8
BROADCAST_ROWS = 100_000


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def units(rows: DataFrame) -> DataFrame:
    """``id``, ``path`` and ``unit``, distinct, of ``rows`` (``id``, ``path``, ``text``)."""
    named = F.element_at(F.split("path", "/", -1), -1).rlike(LICENSE_FILE)
    held = rows.select("id", "path", "text", named.alias("named")).where(F.col("text").rlike(CUE) | (F.col("named") & F.col("text").isNotNull()))
    held = held.withColumn("parts", F.split(F.regexp_replace("text", LINE_END, "\n"), PARAGRAPH_END, -1))
    told = F.filter("parts", lambda u: F.col("named") | u.rlike(CUE))
    lines = F.filter(F.flatten(F.transform(told, lambda u: F.split(u, "\n", -1))), lambda u: u.rlike(CUE))
    whole = F.when(F.col("named"), F.array("text")).otherwise(F.array().cast("array<string>"))
    return held.select("id", "path", F.explode(F.array_distinct(F.concat(whole, told, lines))).alias("unit")).distinct()


def match_units(found: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``h1``, ``h2``, ``license`` and ``score`` of the units that are near enough to a template.

    ``found`` has a row for each distinct ``unit`` with its 128-bit hash ``h1``,
    ``h2`` and ``n``, its number of copies, which count in the document
    frequencies.  Weights are (1 + ln tf) * idf.  Equal scores take the
    alphabetically first licence.
    """
    spark = found.sparkSession
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, unit string")
    total = float((found.agg(F.sum("n")).first()[0] or 0) + len(templates))
    counts = found.select("h1", "h2", "n", F.explode(terms(F.col("unit"))).alias("term")).groupBy("h1", "h2", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    theirs = table.select("t", F.explode(terms(F.col("unit"))).alias("term")).groupBy("t", "term").agg(F.count("*").alias("tf"))
    held = counts.select("n", "term").union(theirs.select(F.lit(1).alias("n"), "term"))
    idf = cut(held.groupBy("term").agg((F.log(F.lit(total + 1) / (F.sum("n") + 1)) + 1).alias("idf")))
    weight = (1 + F.log("tf")) * F.col("idf")
    theirs = theirs.join(idf, "term").select("t", "term", weight.alias("w"))
    norms = theirs.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    theirs = cut(theirs.join(norms, "t").groupBy("term").agg(F.collect_list(F.struct("t", (F.col("w") / F.col("norm")).alias("other"))).alias("near")))
    # the templates' words are few; a word outside them only adds to the length of a unit's vector
    mine = counts.join(small(idf, BROADCAST_ROWS), "term").join(F.broadcast(theirs), "term", "left").select("h1", "h2", weight.alias("w"), "near")
    norms = mine.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = mine.where("near is not null").select("h1", "h2", "w", F.explode("near").alias("x")).groupBy("h1", "h2", "x.t").agg(F.sum(F.col("w") * F.col("x.other")).alias("dot"))
    scored = dots.join(norms, ["h1", "h2"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= least)
    best = scored.join(F.broadcast(table.select("t", "license")), "t").groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return best.select("h1", "h2", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def ancestors(directory: Column) -> Column:
    """The directory and every one above it, the nearest first, the root ('') last."""
    parts = F.split(directory, "/", -1)
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(ups, F.array(F.lit(""))))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The licence of every row: ``id_col``, ``path``, ``license``, ``score``, ``origin`` and ``license_dir``.

    ``origin`` is ``header`` (the file's own best unit; equal scores take the
    alphabetically first licence), ``inherited`` (from the nearest directory with
    a licence file; of several files there the best score, then the first
    licence) or ``none``.  Null texts and paths have no header; a null path is in
    the root directory.  Whole texts are read; repeated rows are judged alike.
    """
    ready(files.sparkSession)
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = cut(units(rows).withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")}))
    known = cut(match_units(found.groupBy("h1", "h2").agg(F.first("unit").alias("unit"), F.count("*").alias("n")), templates, least))
    mine = found.select("id", "path", "h1", "h2").join(small(known, BROADCAST_ROWS), ["h1", "h2"])
    own = cut(mine.groupBy("id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("own")))
    name = F.element_at(F.split("path", "/", -1), -1)
    given = own.where(name.rlike(LICENSE_FILE)).groupBy(directory_of(F.col("path")).alias("license_dir")).agg(F.min("own").alias("above"))
    dirs = rows.select(directory_of(F.col("path")).alias("dir")).distinct()
    way = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("steps", "license_dir")).join(given, "license_dir")
    near = cut(way.groupBy("dir").agg(F.min(F.struct("steps", "above", "license_dir")).alias("near")))
    facts = rows.select("id", "path").join(own.withColumnsRenamed({"id": "own_id", "path": "own_path"}), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")), "left")
    facts = facts.withColumn("dir", directory_of(F.col("path"))).join(small(near, BROADCAST_ROWS), "dir", "left")
    pick = F.coalesce("own", "near.above")
    origin = F.when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    shown = F.when(F.col("own").isNull(), F.col("near.license_dir"))
    return facts.select(F.col("id").alias(id_col), "path", pick.license.alias("license"), (-pick.s).alias("score"), origin.alias("origin"), shown.alias("license_dir"))
