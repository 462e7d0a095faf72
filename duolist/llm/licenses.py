"""Licence scan by a positional index of rare words.

Templates are notices that licences ask for, and short phrases that name them. Every template is listed in the index under its
rarest words, those with the highest inverse document frequency over all templates, together with where in it they stand. A text
is cut into words once; only words of the index are looked at further. Each of them says where a template would have to begin;
where enough of a template's rare words agree on that, but for a few words put in or left out, its mandatory key phrases are
looked for at their places, and what share of its words stands there gives the similarity.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import id_and_text, ids_of, map_batches, record, text_bytes

#: Phrases that count as base, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short phrases that name a licence, found only as they stand.
NAMES = {
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier gpl 2 0": "gpl",
    "spdx license identifier gpl 3 0": "gpl",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier lgpl 3 0": "lgpl",
    "spdx license identifier agpl 3 0": "agpl",
    "spdx license identifier mpl 2 0": "mpl",
    "spdx license identifier bsd 2 clause": "bsd",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier isc": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
}
#: Fixed values: (label, notice, mandatory key phrases) as the licences themselves word them.
NOTICES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["you may not use this file except in compliance with the license", "without warranties or conditions of any kind"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted"]),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["you can redistribute it and or modify it under the terms of the gnu general public license"],
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ["under the terms of the gnu lesser general public license"],
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["under the terms of the gnu affero general public license"],
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["subject to the terms of the mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["made available under the terms of the eclipse public license"]),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ["any person or organization obtaining a copy of the software", "to prepare derivative works of the software"],
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ["permission is granted to anyone to use this software for any purpose", "to alter it and redistribute it freely"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software released into the public domain"],
    ),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["has waived all copyright and related or neighboring rights"]),
]
#: Rare words by which a notice is listed, at most; how many words may have been put in or left out; share of the rare words that must agree, and of all words for a hit.
RARE_WORDS, SLACK, AGREE, SIMILARITY = 12, 6, 0.5, 0.75
#: Bytes of a text that are cut into words at a time.
AT_ONCE = 4 << 20
#: What stands between words becomes a blank, A-Z lower case; bytes from 128 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """label: what it shows; words: in order; keys: (place, words) of mandatory phrases; base: whether it is a base phrase;
    exact: whether all words must stand side by side."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool = False
    exact: bool = True


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


def phrase(text: str, label: str, base: bool = False) -> Template:
    own = tuple(words_of(text.encode()))
    return Template(label, own, ((0, own),), base)


def notice(label: str, text: str, keys: list[str]) -> Template:
    """ValueError if a key phrase isn't in the text."""
    own, placed = tuple(words_of(text.encode())), []
    for k in keys:
        part = tuple(words_of(k.encode()))
        at = next((i for i in range(len(own)) if own[i : i + len(part)] == part), None)
        if at is None:
            raise ValueError(f"{label}: {k} isn't part of the notice")
        placed.append((at, part))
    return Template(label, own, tuple(placed), exact=False)


def standard_templates() -> list[Template]:
    return [phrase(p, label, True) for p, label in BASE_PHRASES.items()] + [phrase(p, label) for p, label in NAMES.items()] + [notice(*n) for n in NOTICES]


@dataclass(frozen=True)
class Hit:
    """A template found at words start to end; similarity is the share of its words, weighed by rarity, that stand there."""

    label: str
    start: int
    end: int
    similarity: float
    base: bool


class Index:
    """Positional postings of templates under their rarest words."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        df = Counter(w for t in templates for w in set(t.words))
        self.idf = {w: math.log(1 + len(templates) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need: list[int] = []
        for i, t in enumerate(templates):
            by_rarity = sorted(range(len(t.words)), key=lambda p: (-self.idf[t.words[p]], p))
            chosen = by_rarity[: min(2, len(t.words)) if t.exact else RARE_WORDS]
            self.need.append(len(chosen) if t.exact else max(1, math.ceil(AGREE * len(chosen))))
            for p in chosen:
                self.postings[t.words[p]].append((i, p))
        self.overlap = max(len(t.words) for t in templates) + 2 * SLACK

    def hits(self, words: list[bytes], own: int = 0) -> Iterator[Hit]:
        """Templates found in words; base phrases only where they end at or behind word `own`."""
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        postings = self.postings
        for at, w in enumerate(words):
            if w in postings:
                for i, p in postings[w]:
                    starts[i].append((at - p, p))
        for i, found in starts.items():
            t = self.templates[i]
            slack = 0 if t.exact else SLACK
            found.sort()
            low = 0
            for k in range(1, len(found) + 1):
                if k < len(found) and found[k][0] - found[k - 1][0] <= slack:
                    continue
                group = found[low:k]
                low = k
                if len({p for _, p in group}) >= self.need[i] and (hit := self._verified(t, words, group[0][0], group[-1][0], slack, own)):
                    yield hit

    def _verified(self, t: Template, words: list[bytes], first: int, last: int, slack: int, own: int) -> Hit | None:
        """The hit of a template that would begin somewhere from first to last, if its key phrases stand at their places."""
        for place, part in t.keys:
            if not any(tuple(words[s : s + len(part)]) == part for s in range(max(0, first + place - slack), last + place + slack + 1)):
                return None
        start, end = max(0, first), min(len(words), last + len(t.words))
        if t.exact:
            return Hit(t.label, start, end, 1.0, t.base) if end > own or not t.base else None
        wanted, there = Counter(t.words), Counter(words[max(0, first - slack) : last + len(t.words) + slack])
        similarity = sum(self.idf[w] * min(n, there[w]) for w, n in wanted.items()) / sum(self.idf[w] * n for w, n in wanted.items())
        return Hit(t.label, start, end, min(1.0, similarity), False) if similarity >= SIMILARITY else None

    @staticmethod
    def longest(hits: list[Hit]) -> list[Hit]:
        """hits by place, without those that lie within a longer one; base phrases stay all."""
        out, reach = [], -1
        for h in sorted(hits, key=lambda h: (h.start, -h.end, h.label, h.base)):
            if h.base or h.end > reach or (out and (out[-1].start, out[-1].end) == (h.start, h.end)):
                out.append(h)
            reach = max(reach, h.end)
        return out

    def scan(self, text: bytes, at_once: int = AT_ONCE) -> tuple[int, list[Hit]]:
        """(number of words, hits) of a whole text; a very long one is looked at part by part, with an overlap of the longest template."""
        if len(text) <= at_once:
            words = words_of(text)
            return len(words), self.longest(list(self.hits(words)))
        out: dict[tuple[str, int, int, bool], Hit] = {}
        carried: list[bytes] = []
        at = n = 0
        while at < len(text):
            end = at + at_once
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
            new = words_of(text[at:end])
            base = n - len(carried)
            for h in self.hits(carried + new, len(carried)):
                moved = Hit(h.label, h.start + base, h.end + base, h.similarity, h.base)
                key = (h.label, moved.start, moved.end, h.base)
                out[key] = max(moved, out.get(key, moved), key=lambda x: x.similarity)
            n, at = n + len(new), end
            carried = (carried + new)[-self.overlap :]
        return n, self.longest(list(out.values()))


@lru_cache(maxsize=4)
def _index(templates: tuple[Template, ...]) -> Index:
    return Index(list(templates))


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits) of every whole text; hits: array of (label, start, end, similarity, base), by place.

    start and end count words from 0. Null and empty texts have no words and no hits; null and repeated doc_ids and repeated rows
    are scanned like any other; other columns aren't read; an empty table gives an empty table. Nothing is shuffled.
    """
    fixed = tuple(standard_templates() if templates is None else templates)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("base", pa.bool_())]))

    def make():
        index = _index(fixed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, found = [], []
            for text in text_bytes(batch.column(1)):
                n, hits = index.scan(text)
                counts.append(n)
                found.append([vars(h) for h in hits])
            return record(doc_id=ids_of(batch), n_words=pa.array(counts, pa.int64()), hits=pa.array(found, kind))

        return step

    return map_batches(id_and_text(docs, id_col, text_col), make, "doc_id long, n_words long, hits array<struct<label: string, start: long, end: long, similarity: double, base: boolean>>")


def license_labels(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of what scan() gives.

    first_word and last_word are the smallest and largest start of a base phrase, null without one; score is the greatest
    similarity of a hit, 0 without one.
    """
    base = F.filter("hits", lambda h: h["base"])

    def names(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias("score"),
    )
