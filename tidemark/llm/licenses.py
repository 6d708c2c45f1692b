"""License notices by an exact set-similarity join of text blocks with templates.

Blocks are windows over a text's words, or its lines, as sets of words; a template matches a block that has at least the
share THRESHOLD of the template's words. Templates, from a line to a whole licence, are taken by length in CLASSES. Windows
are twice as long as the longest template of a class and start every such length, so that a notice of no more words lies
within one, however it is wrapped, and words further apart do not meet.
Words are ordered by how many documents have them, rarest first. Sets that reach the threshold share a word among the
first few of each (prefix filter); a block must have enough of the templates' words (length filter), and the places of the
first shared word must leave room for enough others (positional filter). The pairs that pass are counted out. Templates are
a parameter; a pass over the texts takes as many as have PASS_WORDS words, further ones are taken by further passes.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Distinct words of the templates that one pass takes, or one template.
PASS_WORDS = 4000
#: Templates of at most so many words share windows of one length; longer ones have windows of the longest's.
CLASSES = (32, 128)

#: Characters that separate words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases of the digest query and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of common notices, and of licences short enough to stand in files whole.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-sa", "CC BY-SA"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
)


def template_words(wording: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(r"[0-9a-z]+", wording.lower()))))


def needed(n: int, threshold: float) -> int:
    """The least overlap of a template of n words."""
    return max(1, math.ceil(round(threshold * n, 9)))


def _lower(text: Column) -> Column:
    """Lower case that makes an ASCII word of an ASCII word alone: the Kelvin sign must not become a k."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("Å")))


def _spaced(text: Column) -> Column:
    """The words of a text in lower case, two spaces between them."""
    return F.trim(F.regexp_replace(_lower(text), _GAP + "+", "  "))


def _n_spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


Templates = tuple[tuple[str, str], ...]


def by_length(templates: Templates, windows: bool = True) -> list[tuple[int, list[int]]]:
    """Templates (their places) of each class, with the words of the longest, repeats included: windows start every so
    many words and have twice as many. With lines all are of one class, and its length is 0."""
    if not windows:
        return [(0, list(range(len(templates))))]
    found: dict[int, list[int]] = {}
    size = [len(re.findall(r"[0-9a-z]+", wording.lower())) for _, wording in templates]
    for t, n in enumerate(size):
        found.setdefault(next((c for c in CLASSES if n <= c), 0), []).append(t)
    return sorted((max(size[t] for t in ts), ts) for ts in found.values())


def in_passes(templates: Templates) -> list[Templates]:
    """Templates in order, cut so that those of a pass have at most PASS_WORDS words, or are one."""
    out: list[list[tuple[str, str]]] = []
    room = 0
    for t in templates:
        n = len(template_words(t[1]))
        if n > room or not out:
            out.append([])
            room = PASS_WORDS
        out[-1].append(t)
        room -= n
    return [tuple(x) for x in out]


def _windows(words: Column, step: int) -> Column:
    """Overlapping runs of 2 * step words that cover the words; the last may be shorter."""
    last = F.greatest(F.floor((F.size(words) - step - 1) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, 2 * step))


def _lines(text: Column) -> Column:
    """The words of each line."""
    return F.transform(F.split(text, "\n"), lambda line: F.split(_spaced(line), "  "))


def _tagged(lines: Column, step: int, seeds: Column) -> Column:
    """The lines with a word of seeds, numbered, and none if the text has no such word: a block without a word of any
    prefix of its class matches none."""
    numbered = F.transform(lines, lambda x, i: F.struct(F.lit(step).alias("step"), i.alias("block"), x.alias("line")))
    none = F.array().cast("array<struct<step:int,block:int,line:array<string>>>")
    return F.when(F.arrays_overlap("words", seeds), F.filter(numbered, lambda x: F.arrays_overlap(x["line"], seeds))).otherwise(none)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents have each template word: one row a word comes back."""
    known = F.array_intersect(F.split(_spaced(F.col("text")), "  "), _literals(vocabulary))
    found = docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def matches(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD, windows: bool = True) -> DataFrame:
    """doc_id, text_key, step (of the windows, 0: lines), block (number of the window or line), label, containment: every
    block of docs (doc_id, text_key, text) and template with words of at least the threshold."""
    found = [_matches(docs, part, threshold, windows) for part in in_passes(tuple(t for t in templates if template_words(t[1])))]
    if not found:
        return docs.select("doc_id", "text_key", F.lit(0).alias("step"), F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    return reduce(DataFrame.unionByName, found)


def _matches(docs: DataFrame, templates: Templates, threshold: float, windows: bool) -> DataFrame:
    sets = [(label, template_words(wording)) for label, wording in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    count = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    classes = by_length(templates, windows)

    prefixes, wholes, seeds, least = [], [], {}, {}
    for step, members in classes:
        least[step] = min(needed(len(sets[t][1]), threshold) for t in members)
        starts: set[str] = set()
        for t in members:
            label, ws = sets[t]
            need = needed(len(ws), threshold)
            ordered = sorted(ws, key=rank.__getitem__)
            wholes.append((t, label, [rank[w] for w in ordered], need))
            prefixes += [(step, rank[w], t, i, len(ws), need) for i, w in enumerate(ordered[: len(ws) - need + 1])]
            starts.update(ordered[: len(ws) - need + 1])
        seeds[step] = _literals(sorted(starts))
    spark = docs.sparkSession
    prefix = spark.createDataFrame(prefixes, "step int, rank int, template int, place int, n int, need int")
    whole = spark.createDataFrame(wholes, "template int, label string, ranks array<int>, need int")

    kept = [_tagged(_windows(F.col("words"), step) if windows else _lines(F.col("text")), step, seeds[step]) for step, _ in classes]
    words = docs.select("doc_id", "text_key", "text", F.split(_spaced(F.col("text")), "  ").alias("words"))
    lines = words.where(reduce(Column.__or__, [F.arrays_overlap("words", x) for x in seeds.values()])).select("doc_id", "text_key", F.explode(F.concat(*kept)).alias("x")).select("doc_id", "text_key", "x.*")
    enough = reduce(lambda c, step: c.when(F.col("step") == step, least[step]), list(least), F).otherwise(0)
    ranks = F.map_from_arrays(_literals(vocabulary), F.array(*[F.lit(rank[w]) for w in vocabulary]))
    blocks = lines.select("doc_id", "text_key", "step", "block", F.array_intersect("line", _literals(vocabulary)).alias("known"), enough.alias("least")).where(F.size("known") >= F.col("least"))
    blocks = blocks.select("doc_id", "text_key", "step", "block", "least", F.array_sort(F.transform("known", lambda w: F.element_at(ranks, w))).alias("own"))
    # A block's prefix for the smallest template it could hold; longer templates need less of it.
    first = blocks.select("*", F.posexplode(F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)).alias("at", "rank"))
    left = F.size("own") - F.col("at")
    room = F.least(left, F.col("n") - F.col("place")) >= F.col("need")
    met = first.join(F.broadcast(prefix), ["step", "rank"]).where((F.size("own") >= F.col("need")) & (F.col("at") <= F.size("own") - F.col("need")))
    # The earliest shared word decides: what stands before it on either side is not shared.
    met = met.where(room).select("doc_id", "text_key", "step", "block", "own", "template").distinct()
    shared = F.size(F.array_intersect("own", "ranks"))
    found = met.join(F.broadcast(whole), "template").where(shared >= F.col("need"))
    return found.select("doc_id", "text_key", "step", "block", "label", (shared / F.size("ranks")).alias("containment"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, templates: Templates = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD, windows: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of characters outside ASCII; case is ignored for A-Z. n_base counts the
    places where a phrase's words stand one after another; first_word and last_word are their smallest and largest start
    in words from 0, null without any. labels adds those of the matching templates. score is the largest containment of a
    template that matches, 1 with any phrase, else 0. A null text is empty. Repeated rows get equal rows; an empty table
    gives an empty result; other columns are ignored. Templates are matched with windows over the whole text, or with lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text, F.length(text)).alias("text_key"))
    keys = [(f" {'  '.join(phrase.split())} ", len(phrase.split()), label) for phrase, label in phrases]
    words = rows.select("doc_id", "text_key", F.concat(F.lit(" "), _spaced(F.col("text")), F.lit(" ")).alias("words"))
    many = lambda key: ((F.octet_length("words") - F.octet_length(F.replace("words", F.lit(key), F.lit("")))) / len(key.encode())).cast("long")
    size = F.when(F.col("words") == "  ", 0).otherwise(_n_spaces(F.col("words")) / 2).cast("long")
    counts = words.select("doc_id", "text_key", "words", size.alias("n_words"), *[many(key).alias(f"n_{i}") for i, (key, _, _) in enumerate(keys)])
    n_base = sum((F.col(f"n_{i}") for i in range(1, len(keys))), F.col("n_0"))
    where = lambda i, place: F.when(F.col(f"n_{i}") > 0, place.cast("long"))
    first = [where(i, _n_spaces(F.substring_index("words", key, 1)) / 2) for i, (key, _, _) in enumerate(keys)]
    last = [where(i, F.col("n_words") - n - _n_spaces(F.substring_index("words", key, -1)) / 2) for i, (key, n, _) in enumerate(keys)]
    ends = [F.array_min(F.array_compact(F.array(*first))).alias("first_word"), F.array_max(F.array_compact(F.array(*last))).alias("last_word")]
    own = F.array_compact(F.array(*[F.when(F.col(f"n_{i}") > 0, F.lit(label)) for i, (_, _, label) in enumerate(keys)]))
    base = counts.select("doc_id", "text_key", "n_words", n_base.alias("n_base"), *ends, own.alias("own"))
    found = matches(rows, templates, threshold, windows).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_key") == F.col("f.text_key")), "left")
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("b.doc_id", "n_words", "n_base", "first_word", "last_word", _joined(F.col("own")).alias("base_labels"), _joined(F.concat("own", more)).alias("labels"), score.alias("score"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Digest of the scan of all documents by windows, which finds wrapped notices too."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def license_lines(spark, sf_dir: str) -> DataFrame:
    """The same with lines for blocks."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), windows=False)


def _oracle(windows: bool) -> str:
    classes = by_length(TEMPLATES, windows)
    cases = ", ".join(f"({step}, '{TEMPLATES[t][0]}', [{', '.join(repr(w) for w in template_words(TEMPLATES[t][1]))}])" for step, ts in classes for t in ts)
    blocks = r"SELECT r, 0 AS step, regexp_extract_all(unnest(string_split(t, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lw FROM d"
    if windows:
        cut = "SELECT r, {0} AS step, w[i + 1:i + {1}] AS lw FROM (SELECT r, w, unnest(generate_series(0, greatest(len(w) - {0} - 1, 0), {0})) AS i FROM e)"
        blocks = " UNION ALL ".join(cut.format(step, 2 * step) for step, _ in classes)
    starts = " ".join(
        f"SELECT r, '{label}' AS label, i FROM p WHERE {' AND '.join(f'w[i + {j + 1}] = {word!r}' for j, word in enumerate(phrase.split()))}" + (" UNION ALL" if k < len(PHRASES) - 1 else "")
        for k, (phrase, label) in enumerate(PHRASES)
    )
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), e AS (
  SELECT doc_id, r, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), p AS (
  SELECT r, w, unnest(generate_series(0, len(w) - 1)) AS i FROM e WHERE len(w) > 0
), s AS (
  {starts}
), b AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM s GROUP BY r
), l AS (
  {blocks}
), m AS (
  SELECT r, label, len(list_intersect(lw, ws)) AS c, len(ws) AS n FROM l JOIN (VALUES {cases}) AS v(step, label, ws) USING (step)
), f AS (
  SELECT r, list(DISTINCT label) AS more, max(c / n) AS best FROM m WHERE c >= ceil(0.8 * n - 1e-9) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM e LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


LINES_SQL = _oracle(windows=False)
OP10_SQL = _oracle(windows=True)
