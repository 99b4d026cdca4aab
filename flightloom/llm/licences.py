"""Licence scan: normalised segments against templates by the Dice coefficient over word bigrams.

Segments are each line of a text, the whole text, and blocks: runs of consecutive
lines at least half of whose bigrams are in some template, so a licence that is
wrapped over lines inside a longer text, and the paragraphs of such runs.  A
template can reach the threshold t only for segments whose number of bigrams lies
between size * t / (2 - t) and size * (2 - t) / t, and only in documents that hold
size * t / (2 - t) of its bigrams; that leaves few documents to cut into segments.
Templates are a parameter, so their number does not grow with the data.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# Notices and short licences as published by their authors; the names of holders are left out.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

THRESHOLD = 0.8

#: Two lines at least that are not blank.
SEVERAL = r"[^ \t\r\n][ \t\r]*\n[ \t\r\n]*[^ \t\r\n]"


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of each file `name.txt` in a folder, by name: for long licences, whose texts are not kept here.

    Templates are a fixed list of the caller's, so they are read on the driver."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), "value")
    return sorted((r.name, r.value) for r in rows.where("name <> ''").collect())


def _bigrams_of(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _bigrams(segment: Column) -> Column:
    """Bigrams, repeats included, of the lower-case runs of a-z and 0-9."""
    words = F.split(F.trim(F.regexp_replace(F.lower(segment), "[^a-z0-9]+", " ")), " ")
    return _with(words, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _blocks(lines: Column, every: list[str]) -> Column:
    """Runs of two or more lines that are at least half of template bigrams, then the paragraphs of runs that have several.

    A run that is the whole text is left to segment 0.  In the joined text a line
    of no run is a newline more, and runs hold no empty line."""

    def marked(line: Column) -> Column:
        ours = _with(_bigrams(line), lambda g: 2 * F.size(F.filter(g, lambda x: x.isin(every))) >= F.size(g))
        return F.when(F.length(line) == 0, " ").when(ours, line).otherwise("\n")

    def cut(text: Column) -> Column:
        runs = F.split(text, "\n\n+", -1)
        paragraphs = F.flatten(F.transform(runs, lambda r: _with(F.split(r, "\n(?:[ \t\r]*\n)+", -1), lambda p: F.when(F.size(p) > 1, p).otherwise(F.slice(p, 1, 0)))))
        return F.concat(F.when(F.size(runs) > 1, runs).otherwise(F.slice(runs, 1, 0)), paragraphs)

    return F.filter(_with(F.array_join(F.transform(lines, marked), "\n"), cut), lambda b: b.rlike(SEVERAL))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, licence, score): segments that reach the threshold, each with its best template.

    Segment 0 is the whole text (of several lines), 1 and up are its lines, -1 and
    down its blocks; ties go to the template that is listed first.  Null and empty
    texts have no bigrams and so no rows; texts of any length are read whole; ids
    may be null or repeat, repeated rows give repeated rows.  An empty table or no
    template gives an empty result; other columns are not looked at.
    """
    sets = [(n, name, grams) for n, (name, text) in enumerate(templates) if (grams := _bigrams_of(text))]
    # the small number is for rounding: 3 * 0.8 / 1.2 is a little over 2
    low = [ceil(len(g) * threshold / (2 - threshold) - 1e-9) for _, _, g in sets]
    high = [floor(len(g) * (2 - threshold) / threshold + 1e-9) for _, _, g in sets]
    every = sorted({g for _, _, grams in sets for g in grams})
    arrays = [F.array(*[F.lit(x) for x in g]) for _, _, g in sets]

    def reaches(hits: Column) -> Column:
        found = [F.size(F.array_intersect(hits, mine)) >= lo for mine, lo in zip(arrays, low, strict=True)]
        return reduce(operator.or_, found, F.lit(False))

    def best(grams: Column) -> Column:
        scores = [
            F.struct(F.when(F.size(grams).between(lo, hi), 2.0 * F.size(F.array_intersect(grams, mine)) / (F.size(grams) + F.lit(len(g)))).otherwise(0.0).alias("score"), F.lit(-n).alias("n"), F.lit(name).alias("licence"))
            for (n, name, g), mine, lo, hi in zip(sets, arrays, low, high, strict=True)
        ]
        return F.array_max(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1 - 2**31).alias("n"), F.lit("").alias("licence")), *scores))

    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = picked.where(_with(F.filter(_bigrams(F.col("text")), lambda x: x.isin(every)), reaches))
    lines = F.split("text", "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    numbered = [
        F.transform(whole, lambda x: F.struct(F.lit(0).cast("long").alias("segment"), x.alias("body"))),
        F.transform(lines, lambda x, k: F.struct((k + 1).cast("long").alias("segment"), x.alias("body"))),
        F.transform(_blocks(lines, every), lambda x, k: F.struct((-1 - k).cast("long").alias("segment"), x.alias("body"))),
    ]
    scored = F.transform(F.concat(*numbered), lambda s: F.struct(s["segment"].alias("segment"), _with(F.array_distinct(_bigrams(s["body"])), best).alias("best")))
    return near.select("id", F.inline(scored)).where(F.col("best.score") >= threshold).select("id", "segment", "best.licence", "best.score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    rows = ", ".join("({}, '{}', [{}])".format(n, name, ", ".join(f"'{g}'" for g in _bigrams_of(text))) for n, (name, text) in enumerate(TEMPLATES))
    return rf"""
    WITH templates(n, licence, tgrams) AS (VALUES {rows}),
    known AS (SELECT list(DISTINCT g) AS grams FROM (SELECT unnest(tgrams) AS g FROM templates)),
    docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    worded AS (SELECT *, list_transform(parts, lambda p: string_split(trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), ' ')) AS words FROM docs),
    marked AS (
        SELECT doc_id, text, parts, array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
            CASE WHEN parts[i] = '' THEN ' '
            WHEN 2 * len(list_filter(range(1, len(words[i])), lambda k: list_contains(known.grams, words[i][k] || ' ' || words[i][k + 1]))) >= len(words[i]) - 1 THEN parts[i]
            ELSE chr(10) END), chr(10)) AS joined
        FROM worded, known
    ),
    runs AS (SELECT *, string_split_regex(joined, '

+') AS r FROM marked),
    blocks AS (
        SELECT *, list_filter(list_concat(CASE WHEN len(r) > 1 THEN r ELSE [] END, flatten(list_transform(r, lambda x:
            CASE WHEN len(string_split_regex(x, '
(?:[ 	
]*
)+')) > 1 THEN string_split_regex(x, '
(?:[ 	
]*
)+') ELSE [] END))), lambda b: regexp_matches(b, '{SEVERAL}')) AS b
        FROM runs
    ),
    segments AS (
        SELECT doc_id, 0 AS segment, text AS body FROM blocks WHERE len(parts) > 1
        UNION ALL SELECT doc_id, unnest(range(1, len(parts) + 1)), unnest(parts) FROM blocks
        UNION ALL SELECT doc_id, -unnest(range(1, len(b) + 1)), unnest(b) FROM blocks
    ),
    cut AS (SELECT doc_id, segment, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM segments),
    grams AS (
        SELECT doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cut WHERE len(w) > 1
    ),
    scored AS (
        SELECT doc_id, segment, n, licence, 2.0::DOUBLE * len(list_intersect(g, tgrams)) / (len(g) + len(tgrams)) AS score FROM grams, templates
    )
    SELECT doc_id, segment::BIGINT AS segment, licence, score FROM scored WHERE score >= {THRESHOLD}::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY score DESC, n) = 1
    """
