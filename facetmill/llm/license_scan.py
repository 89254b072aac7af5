"""License scan by a positional index of rare words.

Of each licence template the words that are in the fewest documents (the highest inverse document
frequency, counted over all documents) are indexed with their positions. A file's words are looked up
there; its places and a template's are intersected by relative position, and where enough postings
agree, the words around must hold one of the template's mandatory key phrases. Three base phrases are
located exactly.

DataFrame expressions only; time grows with the words of a text, however many statements it holds.
Defined results: null or empty text has no words, no labels and score 0; texts are read whole; words
equally rare are taken longest first, then by name; repeated rows stay, each with its own result, and
count each in the frequencies; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of these characters' complement, with A-Z taken as lower case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Base phrases and labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: The notice of the GNU licences, and their names.
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free "
    "Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {0} for more details."
)
GNU_NAMES = {
    "gpl-3": ("General Public License", "3", "version 3 of the license"),
    "gpl-2": ("General Public License", "2", "version 2 of the license"),
    "lgpl": ("Lesser General Public License", "3", "gnu lesser general public license"),
    "agpl-3": ("Affero General Public License", "3", "gnu affero general public license"),
}
#: Licence texts and statements: label, text, mandatory key phrases (one of them must be there).
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge to any person obtaining a copy of this software"],
    ),
    ("mit", "Released under the MIT License", ["the mit license"]),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["apache license version 2", "apache org licenses license 2 0"],
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2", "apache 2 0 license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0", "creative commons attribution 3 0"]),
    *[(label, GNU.format(name, version), [phrase]) for label, (name, version, phrase) in GNU_NAMES.items()],
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl-3", "Licensed under the GNU Affero General Public License", ["gnu affero general public license"]),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE.",
        ["permission to use copy modify"],
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software.",
        ["the origin of this software must not be misrepresented"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
        ["free and unencumbered software"],
    ),
]
#: Indexed words of a template at most, and the least share of its postings that must agree.
RARE_WORDS, AGREE = 8, 0.4
#: Words kept on either side of a template's place, for the key phrases.
AROUND = 16
ANCHORS = {"mit": ("license", 3), "apache-2": ("apache", 0), "cc-by-nc": ("cc", 0)}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _low(word: Column) -> Column:
    """A word in lower case if it is of ASCII, as all licence words are; else null."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word))


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), GAP), lambda w: F.length(w) > 0)


def picked(template: list[str]) -> int:
    """How many of a template's words are indexed: the rarer half, ``RARE_WORDS`` at most."""
    return min(RARE_WORDS, max(3, len({w for w in template if len(w) > 1}) // 2 + 1))


def needed(postings: int) -> int:
    """How many postings of a template must agree on its place."""
    return max(2, math.ceil(AGREE * postings))


def index(docs: DataFrame, text: str = "text") -> list[list[tuple[str, int]]]:
    """Of each template the postings (word, position) of its rarest words."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in words_of(t) if len(w) > 1})
    seen = docs.select(F.explode(F.array_distinct(F.filter(F.transform(_words(text), _low), lambda w: w.isin(vocabulary)))).alias("word"))
    df = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}  # bounded by the templates
    out = []
    for _, t, _ in TEMPLATES:
        words = words_of(t)
        rare = sorted({w for w in words if len(w) > 1}, key=lambda w: (df.get(w, 0), -len(w), w))[: picked(words)]
        out.append([(w, i) for i, w in enumerate(words) if w in rare])
    return out


def _base_places(label: str, words: Column, hits: Column) -> Column:
    """Where a base phrase starts: places of its anchor with the other words about it."""
    phrase, (anchor, back) = BASE[label].split(), ANCHORS[label]

    def stands(h: Column) -> Column:
        out = h["word"] == anchor
        for k, w in enumerate(phrase):
            if k != back:
                out &= F.coalesce(_low(F.get(words, h["pos"] + (k - back))) == w, F.lit(False))
        return out

    return F.transform(F.filter(hits, stands), lambda h: (h["pos"] - back).cast("long"))


def _share(words: Column, hits: Column, template: list[str], phrases: list[str], postings: list[tuple[str, int]]) -> Column:
    """The greatest share of the postings that agree on a place whose words hold a key phrase, or null.

    Sorted relative positions: a place begins where the one before is another, and its votes are the
    equal ones that follow."""
    need, most = needed(len(postings)), len(postings)
    places = F.array_sort(F.flatten(F.transform(hits, lambda h: F.array_compact(F.array(*[F.when(h["word"] == w, h["pos"] - i) for w, i in postings])))))

    def agreeing(d: Column) -> Column:
        more = lambda x, i, v: F.coalesce(F.get(d, i + (v - 1)) == x, F.lit(False))
        votes = lambda x, i: sum((more(x, i, v).cast("int") for v in range(need + 1, most + 1)), F.lit(need))
        first = lambda x, i: more(x, i, need) & ~F.coalesce(F.get(d, i - 1) == x, F.lit(False))
        return F.array_compact(F.transform(d, lambda x, i: F.when(first(x, i), F.struct(x.alias("at"), votes(x, i).alias("votes")))))

    def stated(c: Column) -> Column:
        near = F.slice(words, F.greatest(c["at"] - AROUND, F.lit(0)) + 1, len(template) + 2 * AROUND)
        near = F.concat(F.lit(" "), F.array_join(F.transform(near, lambda w: F.coalesce(_low(w), F.lit("?"))), " "), F.lit(" "))
        return let(near, lambda s: F.array_contains(F.array(*[s.contains(f" {p} ") for p in phrases]), True))

    found = let(places, lambda d: F.filter(agreeing(d), stated))
    return F.array_max(F.transform(found, lambda c: c["votes"])) / float(most)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    postings = index(docs, text)
    vocabulary = sorted({w for p in postings for w, _ in p} | {a for a, _ in ANCHORS.values()})
    matches = "array<struct<label:string,share:double>>"

    def of(words: Column) -> Column:
        hits = F.array_compact(F.transform(words, lambda w, i: F.when(_low(w).isin(vocabulary), F.struct(i.alias("pos"), F.lower(w).alias("word")))))

        def judged(h: Column) -> Column:
            base = {label: _base_places(label, words, h) for label in BASE}
            shares = [(label, _share(words, h, words_of(t), phrases, p)) for (label, t, phrases), p in zip(TEMPLATES, postings)]
            matched = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), s.alias("share")) for label, s in shares]), lambda m: m["share"].isNotNull())
            bases = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(k)) for k, p in base.items()]))
            none = lambda kind: F.array().cast(kind)
            some = F.size(h) > 0
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.when(some, F.concat(*base.values())).otherwise(none("array<bigint>")).alias("places"),
                F.when(some, bases).otherwise(none("array<string>")).alias("bases"),
                F.when(some, matched).otherwise(none(matches)).alias("matched"),
            )

        return let(hits, judged)

    found = docs.select(key, let(_words(text), of).alias("found")).select(key, "found.*")
    return found.select(
        key,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort("bases"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bases", F.transform("matched", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("bases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matched", lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )
