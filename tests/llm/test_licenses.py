import math
import os
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import licenses

FILES = [
    ("LICENSE", "Licensed under the Apache License, Version 2.0.", True),
    ("src/COPYING", "This work is licensed under the GNU General Public License, version 3.", True),
    ("src/a.py", "x = 1\n# SPDX-License-Identifier: MIT\n", False), ("src/b.py", "nothing here", False), ("src/deep/er/c.py", None, False),
    ("src/deep/d.py", "this licence text resembles no template at all, whatever else it says about permission", False),
    ("docs/e.md", "", False), ("f.txt", "Released under the MIT License. Released under the MIT License.", False), ("f.txt", "Released under the MIT License. Released under the MIT License.", False),
    ("docs/long.txt", "word " * 50_000 + ". Licensed under CC BY-NC 4.0.", False), (None, "Licensed under CC BY-NC 4.0", True), (None, "x", False),
    ("other/NOTICE.md", "Licensed under CC BY-SA 4.0.", True), ("other/LICENSE-b", "Licensed under CC BY-SA 4.0.", True), ("other/sub/x", "y", False),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], "path string, text string, declares boolean, score int, prefix string")


def brute(rows):
    texts = [t or "" for _, t, _ in rows]
    vocabulary = set(licenses.VOCABULARY)
    df = Counter(w for t in texts for w in set(re.findall("[a-z0-9]+", t.lower())) & vocabulary)
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1 if w in vocabulary else math.log(1 + len(rows)) + 1
    out = []
    for (path, _, _), text in zip(rows, texts):
        whole = path and re.match(licenses.LICENCE_FILE, path.split("/")[-1])
        parts = [text] if whole else re.split(licenses.SEPARATOR, text)
        best = (0.0, 0)
        for part in parts:
            if not re.search(licenses.CUE, part):
                continue
            own = Counter(re.findall("[a-z0-9]+", part.lower()))
            for k, vector in enumerate(licenses.VECTORS):
                dot = sum(math.sqrt(own[w] * n) * idf(w) ** 2 for w, n in vector.items())
                score = dot / math.sqrt(sum(n * idf(w) ** 2 for w, n in own.items()) * sum(n * idf(w) ** 2 for w, n in vector.items()))
                best = max(best, (round(score, 6), -k))
        out.append((best[0], licenses.TEMPLATES[-best[1]][0]) if best[0] >= licenses.THRESHOLD else None)
    return out


def test_scan_and_inheritance(spark):
    rows = licenses.inherit(licenses.scan(frame(spark, FILES))).collect()
    assert len(rows) == len(FILES)
    expected = Counter((p, m and round(m[0], 4), m and m[1]) for (p, _, _), m in zip(FILES, brute(FILES)))
    assert Counter((r.path, r.licence_match and round(r.licence_match.score, 4), r.licence_match and r.licence_match.licence) for r in rows) == expected
    by_path = {r.path: (r.licence, r.licence_source, r.licence_directory, r.licence_distance) for r in rows if r.path}
    assert by_path["src/a.py"] == ("MIT", "file", None, None)
    assert by_path["src/b.py"] == ("GPL-3.0", "directory", "src", 0)
    assert by_path["src/deep/er/c.py"] == ("GPL-3.0", "directory", "src", 2)
    assert by_path["src/deep/d.py"] == ("GPL-3.0", "directory", "src", 1)
    assert by_path["docs/e.md"] == ("Apache-2.0", "directory", "", 1)
    assert by_path["docs/long.txt"][:2] == ("CC-BY-NC-4.0", "file")
    assert by_path["f.txt"][:2] == ("MIT", "file")
    assert by_path["other/sub/x"] == ("CC-BY-SA-4.0", "directory", "other", 1)
    assert [r.licence_source for r in rows if r.path is None and r.text == "x"] == ["none"]
    assert all(r.score == 7 and r.prefix == "clash" for r in rows)


def test_every_template_matches_itself(spark):
    rows = [(f"d/{k}", text, False) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.path: r.licence_match for r in licenses.scan(frame(spark, rows)).collect()}
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        assert re.search(licenses.CUE, text) and got[f"d/{k}"].licence == name


MIT = """MIT License

Copyright (c) 2021 Some Body and Others

""" + textwrap.fill(licenses.FILE_TEMPLATES[0][1].removeprefix("MIT License. "), 72)
BSD_2 = "Copyright (c) 2019, Some Body\nAll rights reserved.\n\n" + textwrap.fill(licenses._BSD[0], 76) + "\n\n" + textwrap.fill(licenses._BSD[2], 76)
BSD_3 = "Copyright (c) 2019, Some Body\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(x, 76) for x in licenses._BSD)
LICENCES = "/usr/share/common-licenses"


def test_full_texts_of_licence_files(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3}
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}.items():
        if os.path.exists(f"{LICENCES}/{file}"):
            texts[name] = open(f"{LICENCES}/{file}").read()
    rows = [row for name, text in texts.items() for row in ((f"{name}/LICENSE", text, True), (f"{name}/src/x.py", "x = 1", False))]
    rows.append(("none/LICENSE", "You have permission to read this licence of our own making, and nothing else follows from it.", True))
    got = {r.path: r.licence for r in licenses.inherit(licenses.scan(frame(spark, rows))).collect()}
    assert got == {p: None if p.startswith("none") else p.split("/")[0] for p, _, _ in rows}


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = licenses.scan(docs.withColumn("path", F.lit("a/b")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_documents_match_sql(spark):
    rows = [(i, t, ["en", None][i % 2], f"s{i % 3}" if i % 7 else None) for i, t in enumerate(["plain words", "Licensed under CC BY-NC 4.0.\nmore; words. here", None, "", "x\nThis work is licensed under the GNU General Public License, version 3. And more", "a licence of some kind"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    c = duckdb.connect()
    table = docs.toArrow()
    c.register("documents", table)
    got = licenses.document_licences(docs)
    expected = c.sql(licenses.ORACLE)
    assert got.columns == expected.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected.fetchall()))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_tables_match_sql(spark):
    c = duckdb.connect()
    c.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = licenses.document_licences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, c.sql(licenses.ORACLE).fetchall()))
    assert sum(r.licence_source == "file" for r in got) > 5


def test_empty(spark):
    assert licenses.document_licences(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
