"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined by Spark with the template positions that hold the same k-gram.
A hit at document place i and template place j votes for diagonal i - j; votes are counted per (document, template,
diagonal), and neighbouring diagonals are merged into one span, so that a missing or an added word does not break it.  A
span is verified on words: of the window that its diagonals give the whole template, the longest common subsequence with the
template must hold ``percent`` / 100 of the longer of the two, so one changed word costs one word.

The template table is fixed and small (its row count is checked before it is broadcast), so the many k-grams of the corpus
are never shuffled: only hits are.  A k-gram in very many documents is one broadcast row, so it makes no hot key.  Words are
cut once for the hits and the base phrases; only documents with a span are read again, for the words of their windows.

Defined results: null text is empty; documents without words have no hits; a repeated row (same id and text) is counted once
in the votes and answered alike; a null id is a value like any other; results have their own columns, so clashing names do
no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import ascii_lower, cut

# Well-known public licence notices and the sentences that stand for them, by label.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "This project is licensed under the Apache License 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following:""",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "cc": (
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "lgpl": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version.""",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "mpl": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions:""",
    ),
}
# Base phrases and their labels.
BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Words of a text once A-Z is lower-cased, and what parts them.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_ROWS = 100_000


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PARTING), "")


def plain_words(text: str) -> list[str]:
    return re.findall(LICENSE_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _rolling(h: str, k: int) -> Column:
    """Hashes of the k-grams of an array of word hashes; place i covers words i to i + k - 1."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))


def template_table(templates: dict[str, tuple[str, ...]] | None, k: int) -> list[tuple[str, int, list[str]]]:
    """(label, number, words) of every template, each of at least k words."""
    rows = [(label, plain_words(text)) for label, texts in sorted((templates or TEMPLATES).items()) for text in texts]
    for label, words in rows:
        if len(words) < k:
            raise ValueError(f"a {label} template has fewer than {k} words: {' '.join(words)}")
    if sum(len(w) for _, w in rows) > MAX_TEMPLATE_ROWS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_ROWS} words")
    return [(label, n, words) for n, (label, words) in enumerate(rows)]


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit a word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    open_ = full = (1 << len(a)) - 1
    for w in b:
        hit = open_ & places.get(w, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


#: Numbers that lead each document's rolling hashes: words, base places, first and last place, and a bit a base phrase.
FACTS = 5


def scanned(docs: DataFrame, keys: list[str], text: str, k: int, table: list[tuple[str, int, list[str]]]) -> DataFrame:
    """keys, pos, value, label, template, tpos: five facts a document (pos 0 to 4) and its hits (pos - 5 is the place).

    One pass over the texts, in which words are cut once.  Facts and rolling hashes are one array, exploded in its outer form
    (before which Spark puts no filter that would repeat the computation) and joined with the broadcast template places.
    """
    spark = docs.sparkSession
    frame = spark.createDataFrame(table, "label string, template int, words array<string>")
    places = frame.select("label", "template", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).select("label", "template", F.posexplode(_rolling("h", k)).alias("tpos", "hash"))
    words = docs.select(*keys, license_words(F.col(text)).alias("words"))
    phrases = [phrase_places(F.col("words"), p) for _, p in sorted(BASE_PHRASES.items())]
    words = words.select(*keys, F.size("words").cast("long").alias("n"), F.array(*phrases).alias("found"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    every = F.flatten("found")
    bits = sum((F.when(F.size(F.get("found", i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(phrases))), F.lit(0))
    facts = F.array(F.col("n"), *(x.cast("long") for x in (F.size(every), F.coalesce(F.array_min(every), F.lit(-1)), F.coalesce(F.array_max(every), F.lit(-1)), bits)))
    numbers = words.select(*keys, F.concat(facts, _rolling("h", k)).alias("numbers")).select(*keys, F.posexplode_outer("numbers").alias("pos", "value"))
    met = numbers.join(F.broadcast(places), (F.col("value") == F.col("hash")) & (F.col("pos") >= FACTS), "left")
    return met.filter((F.col("pos") < FACTS) | F.col("tpos").isNotNull()).select(*keys, "pos", "value", "label", "template", "tpos")


def verified_spans(docs: DataFrame, hits: DataFrame, keys: list[str], text: str, k: int, percent: int, drift: int, table: list[tuple[str, int, list[str]]]) -> DataFrame:
    """keys, label, template, first_word, last_word, matched, similarity: one row a span of the hits that holds on words."""
    by = [*keys, "label", "template"]
    place = hits.select(*by, (F.col("pos") - FACTS).alias("pos"), "tpos").distinct()
    votes = place.groupBy(*by, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    row = Window.partitionBy(*by).orderBy("diagonal")
    votes = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(row), F.lit(drift + 1)) > drift).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy(*by, "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("from_diagonal"), F.max("diagonal").alias("to_diagonal"))
    # A document's spans meet its text once, in an array.
    inner = F.struct("label", "template", "votes", "low", "high", "from_diagonal", "to_diagonal")
    own = spans.groupBy(*keys).agg(F.collect_list(inner).alias("spans"))
    right = [f"span_{c}" for c in keys]
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in zip(keys, right, strict=True)]
    texts = docs.select(*keys, F.col(text).alias("text_of_span")).join(own.withColumnsRenamed(dict(zip(keys, right, strict=True))), same).dropDuplicates(keys)
    templates = {n: words for _, n, words in table}

    def verify(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, held in zip(texts, spans, strict=True):
            words, found = plain_words(t or ""), []
            for s in held:
                want = templates[s["template"]]
                window = words[max(0, min(s["from_diagonal"], s["low"])) : max(s["to_diagonal"] + len(want), s["high"] + k)]
                n = common_words(want, window)
                found.append({"label": s["label"], "template": s["template"], "first_word": s["low"], "last_word": s["high"] + k - 1, "matched": n, "similarity": n / max(len(want), len(window))})
            out.append([f for f in found if 100 * f["similarity"] >= percent])
        return pd.Series(out)

    result = "array<struct<label:string,template:int,first_word:bigint,last_word:bigint,matched:bigint,similarity:double>>"
    return texts.select(*keys, F.inline(F.pandas_udf(verify, result)(F.col("text_of_span"), F.col("spans"))))


def license_spans(docs: DataFrame, keys: list[str], text: str = "text", k: int = 5, percent: int = 80, drift: int = 3, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """keys, label, template, first_word, last_word, matched, similarity: one row a verified span.

    keys tell documents apart; hits of rows that agree on them count once.
    """
    table = template_table(templates, k)
    return verified_spans(docs, scanned(docs, keys, text, k, table).filter(F.col("pos") >= FACTS), keys, text, k, percent, drift, table)


def license_report(docs: DataFrame, keys: list[str], text: str = "text", k: int = 5, percent: int = 80, drift: int = 3, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """keys, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans: one row a row of docs.

    base_labels are those of BASE_PHRASES, labels those and the verified spans', score the best span's similarity.
    """
    table = template_table(templates, k)
    rows = cut(scanned(docs, keys, text, k, table))
    fact = [F.max(F.when(F.col("pos") == i, F.col("value"))) for i in range(FACTS)]
    copies = F.sum(F.when(F.col("pos") == 0, 1).otherwise(0))
    base = rows.filter(F.col("pos") < FACTS).groupBy(*keys).agg(*(f.alias(n) for f, n in zip(fact, ("n_words", "n_base", "first", "last", "bits"), strict=True)), copies.cast("int").alias("copies"))
    names = sorted(BASE_PHRASES)
    own = F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(names))), lambda x: x.isNotNull())
    spans = verified_spans(docs, rows.filter(F.col("pos") >= FACTS), keys, text, k, percent, drift, table)
    right = [f"found_{c}" for c in keys]
    found = spans.groupBy(*(F.col(c).alias(r) for c, r in zip(keys, right, strict=True))).agg(F.collect_set("label").alias("found"), F.max("similarity").alias("similarity"), F.count("*").alias("n_spans"))
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in zip(keys, right, strict=True)]
    out = base.withColumn("base", own).join(found, same, "left")
    out = out.withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    place = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return out.select(*keys, "n_words", "n_base", place("first").alias("first_word"), place("last").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("similarity", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Array of the places where a phrase's words stand one after the other."""
    parts = phrase.split(" ")
    every = F.sequence(F.lit(0), F.size(words) - len(parts))
    fits = lambda i: F.expr("true") if not parts else _all([F.get(words, i + j) == p for j, p in enumerate(parts)])
    # Documents without the phrase's words skip the scan.
    possible = _all([F.array_contains(words, p) for p in parts]) & (F.size(words) >= len(parts))
    return F.when(possible, F.filter(every, fits)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
