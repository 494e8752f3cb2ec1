import re
import textwrap
from collections import Counter
from math import log, sqrt

import duckdb

from quire.llm import license_tfidf as lt
from quire.llm.license_tfidf import scan
from quire.llm.queries import op10_license_scan, oracle_sql


def test_headers_and_inheritance(spark):
    rows = [
        (1, "a/b/x.py", "code\n# Licensed under the Apache License, version 2.0\ncode"), (2, "a/b/y.py", "code"), (3, "a/LICENSE", "Released under the MIT License."),
        (4, "a/b/c/z.py", ""), (5, "q/z.py", None), (6, "a/b/NOTICE.txt", "Licensed under CC BY-NC 4.0."), (7, "r.txt", "no licence is given for anything in this house"), (8, None, "x"), (9, "ab/z.py", "x"),
        (2, "a/b/y.py", "code"), (None, "a/n.py", "x " * 100_000),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 as id", "2 as line", "3 as license", "4 as h1", "5 as dir")
    got = sorted((r.doc_id or 0, r.license, r.origin, r.license_dir) for r in scan(files).collect())
    assert got == [
        (0, "MIT", "inherited", "a"), (1, "Apache-2.0", "header", None), (2, "CC-BY-NC-4.0", "inherited", "a/b"), (2, "CC-BY-NC-4.0", "inherited", "a/b"), (3, "MIT", "header", None),
        (4, "CC-BY-NC-4.0", "inherited", "a/b"), (5, None, "none", None), (6, "CC-BY-NC-4.0", "header", None), (7, None, "none", None), (8, None, "none", None), (9, None, "none", None),
    ]
    assert scan(files.limit(0)).count() == 0


def wrapped(text, mark, width=72):
    return "\n".join(f"{mark}{x}".rstrip() for x in textwrap.wrap(text, width))


def test_real_licence_files_and_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2021 Jane Roe and others\n\n" + wrapped(lt._MIT, "") + "\n\n" + wrapped(lt._MIT_END, "")
    bsd = f"Copyright (c) 2019, Some Firm\nAll rights reserved.\n\n{wrapped(lt._BSD, '')}\n\n" + "\n\n".join(wrapped(x, "* ") for x in (lt._BSD_TWO, lt._BSD_THIRD)) + "\n\n" + wrapped(lt._BSD_END, "")
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + "long text of its own " * 900
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n" + "terms " * 3000
    header = "#!/usr/bin/python\n#\n# Copyright 2020 The Authors\n#\n" + wrapped('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "# ", 60) + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\nimport x"
    lesser = "/*\n" + wrapped(lt._GPL.format("Lesser ", 3), " * ", 50) + "\n */\nint x;"
    rows = [(1, "m/LICENSE", mit), (2, "m/src/a.c", "int x;"), (3, "b/LICENSE.txt", bsd), (4, "b/x", ""), (5, "p/COPYING", apache), (6, "p/q/r/s.c", None), (7, "g/COPYING", gpl), (8, "g/x.c", "x"), (9, "h.py", header), (10, "l.c", lesser), (11, "s.c", "// SPDX-License-Identifier: BSD-2-Clause\nx"), (12, "t.c", "// SPDX-License-Identifier: EPL-1.0\nx"), (13, "m/u.py", lesser)]
    got = {r.doc_id: (r.license, r.origin) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "header"), 4: ("BSD-3-Clause", "inherited"), 5: ("Apache-2.0", "header"), 6: ("Apache-2.0", "inherited"), 7: ("GPL-3.0", "header"), 8: ("GPL-3.0", "inherited"),
        9: ("Apache-2.0", "header"), 10: ("LGPL-3.0", "header"), 11: ("BSD-2-Clause", "header"), 12: (None, "none"), 13: ("LGPL-3.0", "header"),
    }


def test_scores_against_brute_force(spark):
    texts = ["Released under the MIT license", "All rights reserved. Copyright 2001", "Redistribution and use in binary forms are permitted if the following conditions are met", "a copyright of nobody", "MIT License", "\n#\n".join(["x", "# Released under\n# the MIT License"])]
    rows = [(i, f"f{i}.c", t) for i, t in enumerate(texts)]
    found = [(i, u) for i, t in enumerate(texts) for p in re.split(r"\n\n+", re.sub(lt.LINE_END, "\n", t)) for u in {p, *p.split("\n")} if re.search(lt.CUE, u)]
    bags = [(i, Counter(re.findall("[a-z0-9]+", u.lower()))) for i, u in found]
    held = Counter(w for _, b in bags for w in b) + Counter(w for _, t in lt.TEMPLATES for w in set(re.findall("[a-z0-9]+", t.lower())))
    total = len(bags) + len(lt.TEMPLATES)

    def vector(bag):
        x = {w: (1 + log(n)) * (log((total + 1) / (held[w] + 1)) + 1) for w, n in bag.items()}
        size = sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()}

    want = {}
    for i, bag in bags:
        for name, text in lt.TEMPLATES:
            mine, other = vector(bag), vector(Counter(re.findall("[a-z0-9]+", text.lower())))
            score = round(sum(v * other.get(w, 0) for w, v in mine.items()), 9)
            if score >= 0.8:
                want[i] = min(want.get(i, (0, "")), (-score, name))
    got = {r.doc_id: (-r.score, r.license) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect() if r.license}
    assert got == want and 2 <= len(want) < 6


def test_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    cols = "doc_id, path, license, score, origin, license_dir"
    want = con.sql(f"select {cols} from (" + oracle_sql()["op10_license_scan"] + ") order by doc_id").fetchall()
    got = op10_license_scan(spark, data).selectExpr(cols.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert {r.origin for r in got} == {"header", "inherited", "none"}
