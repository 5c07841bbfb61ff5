"""License scans by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Built-in functions only. A file's statements are its lines and sentences that hold a licence cue; a licence file, told by
its name, is one statement as a whole, and as a whole and by paragraphs it is also compared with licences in full and the
titles of long ones, all terms of equal weight. Components are the square root of a term's count times its inverse document
frequency over all files. Terms outside the templates' vocabulary only lengthen a statement's vector, each weighted as a
term of no other file. The scan is a projection of each row, so rows need no identity and nothing is shuffled.

A directory's licence is the best match among its licence files and the files that declare it. A file without a match of
its own inherits from the nearest directory above it that has a licence: directories are spread into their prefixes and
joined by path, then files join their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import checkpoint

TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: For licence files: short licences in full, and the titles that long ones open with.
FILE_TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "".join(_BSD)),
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
CUE = r"(?i)licen[cs]e|copyright|spdx|redistribut|permission|public domain"
SEPARATOR = r"\n|[.;]\s+"
TERM = "[a-z0-9]+"
PARAGRAPH = r"\n\s*\n"
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([-_.].*)?$"
THRESHOLD = 0.7

VECTORS = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
VOCABULARY = sorted(set().union(*VECTORS))
FILE_VECTORS = [Counter(re.findall(TERM, text.lower())) for _, text in FILE_TEMPLATES]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def inverse_frequencies(files: DataFrame, text_col: str) -> tuple[dict[str, float], float]:
    """ln((1 + files) / (1 + files that hold the term)) + 1 for the vocabulary, and for a term that no file holds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.array_union(F.array_intersect(terms(text), F.array(*map(F.lit, VOCABULARY))), F.array(F.lit("")))
    counts = dict(files.select(F.explode(held).alias("term")).groupBy("term").count().collect())
    n = counts.pop("", 0)
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}, math.log(1 + n) + 1


def best_match(statements: Column, idf: dict[str, float], unseen: float, vectors: list[Counter] = VECTORS) -> Column:
    """Struct (score, template, place) of an array of statements' best match; null for none. Ties: first template, then first place."""
    terms_of = sorted(set().union(*vectors))
    squares = F.create_map(*[x for t in terms_of for x in (F.lit(t), F.lit(idf[t] ** 2))])
    vocabulary = F.array(*map(F.lit, terms_of))
    split = F.transform(statements, terms)
    parts = F.transform(split, lambda t: F.struct(
        F.aggregate(t, F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(squares, x), F.lit(unseen**2))).alias("square"),
        F.filter(t, lambda x: F.array_contains(vocabulary, x)).alias("known"),
    ))
    counted = F.transform(parts, lambda p: F.struct(
        p["square"].alias("square"), F.transform(vocabulary, lambda v: F.sqrt(F.size(F.filter(p["known"], lambda x: x == v)))).alias("roots"),
    ))
    place = {t: i + 1 for i, t in enumerate(terms_of)}

    def against(c: Column, k: int) -> Column:
        vector = vectors[k]
        norm = math.sqrt(sum(n * idf[t] ** 2 for t, n in vector.items()))
        dot = sum((F.element_at(c["roots"], place[t]) * F.lit(math.sqrt(n) * idf[t] ** 2 / norm) for t, n in sorted(vector.items())), F.lit(0.0))
        score = F.when(c["square"] > 0, F.round(dot / F.sqrt(c["square"]), 6)).otherwise(F.lit(0.0))
        return F.struct(score.alias("score"), F.lit(-k).alias("template"))

    scored = F.transform(counted, lambda c, i: F.struct(F.array_max(F.array(*[against(c, k) for k in range(len(vectors))])).alias("best"), (-i).alias("place")))
    return F.array_max(scored)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files with licence_match added: (score, licence, statement's place) where the best score reaches THRESHOLD, else null.

    A null or empty text matches nothing, a null path is no licence file, repeated rows are scanned alike.
    """
    idf, unseen = inverse_frequencies(files, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.coalesce(F.element_at(F.split(F.col(path_col), "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    statements = F.when(whole, F.array(text)).otherwise(F.filter(F.split(text, SEPARATOR), lambda s: s.rlike(CUE)))
    found = F.when(text.rlike(CUE), best_match(statements, idf, unseen))
    in_full = F.concat(F.array(text), F.split(text, PARAGRAPH))
    full = F.when(whole & text.rlike(CUE), best_match(in_full, dict.fromkeys(set().union(*FILE_VECTORS), 1.0), 1.0, FILE_VECTORS))

    def named(m: Column, templates: list[tuple[str, str]]) -> Column:
        names = F.array(*[F.lit(name) for name, _ in templates])
        return F.when(m["best"]["score"] >= THRESHOLD, F.struct(
            m["best"]["score"].alias("score"), F.element_at(names, 1 - m["best"]["template"]).alias("licence"), (-m["place"]).alias("place"),
        ))

    rows = files.withColumns({"__found": found, "__full": full})
    better = F.coalesce(F.col("__full.best.score") > F.col("__found.best.score"), F.lit(False))
    match = F.when(better, named(F.col("__full"), FILE_TEMPLATES)).otherwise(named(F.col("__found"), TEMPLATES))
    return rows.withColumn("licence_match", match).drop("__found", "__full")


def directory_of(path: Column) -> Column:
    """The path up to its last slash; empty for a file at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds licence_source ('file', 'directory', 'none'), licence, licence_directory and licence_distance (levels up).

    scanned: path, declares (whether a file's own match also holds for its directory) and licence_match besides any other
    columns. Of a directory's declared matches the best score wins, ties by path. A null path inherits nothing.
    """
    rows = scanned.withColumn("licence_of", directory_of(F.col("path")))
    declared = rows.where(F.col("declares") & F.col("licence_match").isNotNull() & F.col("path").isNotNull())
    order = F.struct(-F.col("licence_match.score"), F.col("path"))
    licensed = declared.groupBy(F.col("licence_of").alias("prefix")).agg(F.min_by("licence_match.licence", order).alias("found"))
    below = rows.where(F.col("licence_of").isNotNull()).select("licence_of").distinct()
    names = F.split("licence_of", "/")
    prefixes = F.concat(
        F.transform(F.sequence(F.size(names), F.lit(1), F.lit(-1)), lambda n: F.struct((F.size(names) - n).alias("up"), F.array_join(F.slice(names, 1, n), "/").alias("prefix"))),
        F.when(F.col("licence_of") != "", F.array(F.struct(F.size(names).alias("up"), F.lit("").alias("prefix")))).otherwise(F.array().cast("array<struct<up:int,prefix:string>>")),
    )
    spread = below.select("licence_of", F.inline(prefixes))
    nearest = spread.join(licensed, "prefix").groupBy("licence_of").agg(F.min(F.struct("up", "prefix", "found")).alias("near"))
    out = rows.join(nearest, "licence_of", "left")
    own = F.col("licence_match").isNotNull()
    inherited = ~own & F.col("near").isNotNull()
    return out.withColumns({
        "licence_source": F.when(own, "file").when(inherited, "directory").otherwise("none"),
        "licence": F.when(own, F.col("licence_match.licence")).otherwise(F.col("near.found")),
        "licence_directory": F.when(inherited, F.col("near.prefix")), "licence_distance": F.when(inherited, F.col("near.up")),
    }).drop("licence_of", "near")


def document_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, path, licence, licence_source, licence_score, licence_directory, licence_distance) of every document.

    Documents lie in a layout source/lang/hundred/doc_id.txt, null parts as `_`. One whose first line is a statement
    declares its directory's licence.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.expr("doc_id div 100").cast("string"), F.lit("_")), F.concat(part("doc_id"), F.lit(".txt")))
    files = docs.select("doc_id", path.alias("path"), "text")
    opens = F.coalesce(F.element_at(F.split("text", SEPARATOR, 2), 1).rlike(CUE), F.lit(False))
    scanned = checkpoint(scan(files).withColumn("declares", opens).drop("text"))
    return inherit(scanned).select("doc_id", "path", "licence", "licence_source", F.col("licence_match.score").alias("licence_score"), "licence_directory", "licence_distance")


def _values() -> str:
    rows = [f"({k}, '{name}', '{t}', {n})" for k, ((name, _), v) in enumerate(zip(TEMPLATES, VECTORS)) for t, n in sorted(v.items())]
    return ",\n".join(rows)


ORACLE = rf"""
WITH tpl(k, name, term, n) AS (VALUES {_values()}),
files AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce((doc_id // 100)::VARCHAR, '_') AS dir,
         coalesce(doc_id::VARCHAR, '_') || '.txt' AS base FROM documents),
df AS (
  SELECT term, count(*) AS c FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files)
  WHERE term IN (SELECT term FROM tpl) GROUP BY term),
total AS (SELECT count(*) AS n FROM files),
idf AS (
  SELECT DISTINCT tpl.term, pow(ln((1 + total.n) / (1 + coalesce(df.c, 0))::DOUBLE) + 1, 2) AS sq
  FROM total, tpl LEFT JOIN df ON tpl.term = df.term),
norms AS (SELECT k, sqrt(sum(tpl.n * sq)) AS norm FROM tpl JOIN idf USING (term) GROUP BY k),
seg AS (
  SELECT r, s, i FROM (
    SELECT r, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
      SELECT r, regexp_split_to_array(text, '\n|[.;]\s+') AS p FROM files WHERE regexp_matches(text, '{CUE}')))
  WHERE regexp_matches(s, '{CUE}')),
tok AS (SELECT r, i, unnest(regexp_extract_all(lower(s), '{TERM}')) AS term FROM seg),
cnt AS (SELECT r, i, term, count(*) AS n FROM tok GROUP BY ALL),
len AS (
  SELECT r, i, sum(cnt.n * coalesce(sq, pow(ln(1 + total.n) + 1, 2))) AS square FROM total, cnt LEFT JOIN idf USING (term) GROUP BY r, i),
sc AS (
  SELECT r, i, k, round(sum(sqrt(cnt.n) * sqrt(tpl.n) * sq) / any_value(norm) / sqrt(any_value(square)), 6) AS score
  FROM cnt JOIN tpl USING (term) JOIN idf USING (term) JOIN norms USING (k) JOIN len USING (r, i) GROUP BY r, i, k),
best AS (SELECT r, score, k FROM sc QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, k, i) = 1),
own AS (SELECT DISTINCT r, score, name FROM best JOIN tpl USING (k) WHERE score >= {THRESHOLD}),
f AS (
  SELECT files.*, score, name, regexp_matches(regexp_split_to_array(text, '\n|[.;]\s+')[1], '{CUE}') AS declares
  FROM files LEFT JOIN own USING (r)),
licensed AS (SELECT dir AS prefix, name AS found FROM f WHERE declares AND name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/' || base) = 1),
below AS (SELECT DISTINCT dir FROM f),
spread AS (
  SELECT dir, up, array_to_string(string_split(dir, '/')[1:3 - up], '/') AS prefix FROM below, range(0, 4) g(up)),
nearest AS (SELECT dir, up, prefix, found FROM spread JOIN licensed USING (prefix) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY up) = 1)
SELECT doc_id, f.dir || '/' || base AS path, coalesce(name, found) AS licence,
       CASE WHEN name IS NOT NULL THEN 'file' WHEN found IS NOT NULL THEN 'directory' ELSE 'none' END AS licence_source,
       score AS licence_score, CASE WHEN name IS NULL THEN prefix END AS licence_directory,
       CASE WHEN name IS NULL THEN up::INT END AS licence_distance
FROM f LEFT JOIN nearest USING (dir)
"""
