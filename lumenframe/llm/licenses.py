"""Licence scan by diagonal voting, in built-in expressions alone.

Every rolling word k-gram of a text that stands in a template is hashed and joined to the
templates' k-grams; matches are verified word by word and counted by template and diagonal (place
in the text less place in the template). Diagonals up to a slack apart are one span: its words
follow the template's, with no more than the slack of words put in or left out in all. A span
counts if it holds enough of its template. Only k-grams of templates can match, so no other is
hashed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut
from .urlfilter import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and licence texts as they are commonly given, by label (fixed values).
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General
        Public License along with this program. If not, see http://www.gnu.org/licenses/"""),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
GRAM = 3
#: Diagonals of a span lie at most so far apart; the share of a template's k-grams that a span must hold.
SLACK, LEAST = 3, 0.7
#: Template k-grams that are compared as a list within the plan; with more of them, all k-grams of texts are hashed and joined.
LISTED = 20_000


def template_words(text: str) -> list[str]:
    return re.findall(WORD, "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text))


def _places(words: Column, phrase: list[str]) -> Column:
    """Places, from 0, where the words of ``phrase`` stand one after another; null where there are none."""
    starts = F.array_compact(F.transform(words, lambda w, i: F.when(w == phrase[0], i)))
    whole = [F.lit(True)]
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(phrase)][1:] or whole))


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, k: int = GRAM, slack: int = SLACK, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    ``n_base`` counts all places of the ``phrases``, ``first_word`` and ``last_word`` are the
    smallest and largest of them (null without any). ``labels`` adds those of verified template
    spans, and ``score`` is the largest share of a template that a span holds. Null, empty and
    wordless texts have zeros and no labels. Texts of any length are taken whole. Repeated rows and
    null ids keep their rows; other columns are not looked at, whatever their names. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    parsed = [(n, label, template_words(text)) for n, (label, text) in enumerate(templates)]
    if any(len(words) < k for _, _, words in parsed):
        raise ValueError(f"a template has fewer than {k} words")
    vocabulary = sorted({w for _, _, words in parsed for w in words})
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0).alias("words"))
    matches = [Row(template=n, label=label, size=len(ws) - k + 1, place=i, words=ws[i : i + k]) for n, label, ws in parsed for i in range(len(ws) - k + 1)]
    lookup = spark.createDataFrame(matches, "template int, label string, size int, place int, words array<string>")
    gram_of = lambda at: F.xxhash64(*[F.get("words", at + j) for j in range(k)])
    lookup = lookup.select("template", "label", "size", "place", "words", gram_of(F.lit(0)).alias("gram"))
    if len(matches) <= LISTED:
        # Words first, as most k-grams hold one that no template has; then hashes.
        hashes = [r.gram for r in lookup.select("gram").distinct().collect()]
        known = lambda i: F.get("words", i).isin(vocabulary)
        starts = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary) & reduce(lambda a, b: a & b, [known(i + j) for j in range(1, k)], F.lit(True)), i)))
        starts = F.filter(starts, lambda i: gram_of(i).isin(hashes))
    else:
        starts = F.transform(F.slice("words", 1, F.greatest(F.size("words") - (k - 1), F.lit(0))), lambda w, i: i)
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), gram_of(i).alias("gram"), F.slice("words", i + 1, k).alias("given")))
    has = {p: F.array_contains("words", p.split()[-1]) for p, _ in phrases}
    places = [F.when(has[p], _places(F.col("words"), p.split())).otherwise(F.array().cast("array<int>")) for p, _ in phrases]
    staged = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array(*places).alias("places"), grams.alias("grams"))
    rows = cut(staged.withColumn("row", F.monotonically_increasing_id()))

    found = rows.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(lookup, "gram").where(F.col("given") == F.col("words"))
    found = found.withColumn("diagonal", F.col("at") - F.col("place"))
    votes = found.groupBy("row", "template", "label", "size", "diagonal").agg(F.collect_set("place").alias("held"))
    # From every diagonal of a row and a template on, what the next ones hold, as far as the slack goes.
    onwards = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, slack)
    merged = votes.select("row", "label", "size", F.size(F.array_distinct(F.flatten(F.collect_list("held").over(onwards)))).alias("n"))
    verified = merged.withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= least)
    added = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))

    every = F.flatten("places")
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(n))) > 0, label) for n, (_, label) in enumerate(phrases)]))
    told = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.join(added, "row", "left").select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        told(base).alias("base_labels"), told(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.when(F.size(every) > 0, F.lit(1.0)), F.lit(0.0)).alias("score"),
    )
