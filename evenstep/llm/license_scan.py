"""Licence scans with a positional index of rare tokens.

The index holds, for every word of the licence templates, where it stands in which template.
Every template is looked up by the highest-IDF words of its own mandatory key phrase, whatever else
a file holds; a place in the file and a place in a template give a relative position, and places
that agree on one are an alignment. An alignment counts once the key phrase stands at it, word for
word; as it then has all its words there, no key phrase is missed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import doc_texts, per_batch

# Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices of licences: label, wording, and the key phrase in it that must stand in a
# file word for word. What stands in for names and years in them is left out.
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
        "permission is hereby granted free of charge",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
        "apache license version 2",
    ),
    ("gpl-3", "this file is covered by the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this file is covered by the gnu general public license version 2", "gnu general public license version 2"),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    (
        "gpl-3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "gnu general public license as published by the free software foundation version 3",
    ),
    (
        "gpl-2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "gnu general public license as published by the free software foundation version 2",
    ),
    ("gpl-3", "released under the gnu gpl version 3", "gnu gpl version 3"),
    ("gpl-2", "released under the gnu gpl version 2", "gnu gpl version 2"),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
        "gnu lesser general public license",
    ),
    ("lgpl", "under the terms of the gnu library general public license", "gnu library general public license"),
    (
        "agpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "gnu affero general public license",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "redistribution and use in source and binary forms",
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        "permission to use copy modify and or distribute",
    ),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
        "free and unencumbered software",
    ),
)
# Identifiers of licences in SPDX lines, of which later words (such as "or later") may follow.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-3.0": "gpl-3", "GPL-2.0": "gpl-2", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3",
    "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2", "ISC": "isc", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-SA-4.0": "cc-by-sa",
    "CC0-1.0": "cc0", "Unlicense": "unlicense",
}
#: Templates: label, wording and key phrase of each notice and of each SPDX line.
TEMPLATES = (*NOTICES, *((label, f"SPDX-License-Identifier: {name}", f"spdx license identifier {name}") for name, label in SPDX.items()))

#: Bytes that stand in words: digits, letters in lower case and all of non-ASCII characters.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD).split()


class Index:
    """Postings by word: (template, place), of the `rarest` rarest places of each template's key
    phrase. Key phrases as (first place, words)."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, rarest: int = 2):
        self.labels = [label for label, _, _ in templates]
        self.wording = [words_of(t) for _, t, _ in templates]
        self.keys = []
        for k, (_, _, phrase) in enumerate(templates):
            key = words_of(phrase)
            at = [i for i in range(len(self.wording[k])) if self.wording[k][i : i + len(key)] == key]
            if not at:
                raise ValueError(f"no key phrase in template {k}")
            self.keys.append((at[0], key))
        self.vocabulary = frozenset(w for words in self.wording for w in words)
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in phrases.items()]
        self.rarest = rarest
        self.with_counts(0, {})

    def with_counts(self, n: int, df: dict[bytes, int]) -> Index:
        self.idf = {w: log((n + 1) / (df.get(w, 0) + 1)) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (first, key) in enumerate(self.keys):
            for i in sorted(range(len(key)), key=lambda i: (-self.idf[key[i]], key[i], i))[: self.rarest]:
                self.postings[key[i]].append((k, first + i))
        self.needed = [min(self.rarest, len(key)) for _, key in self.keys]
        return self

    def base(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
        """Places of phrases, the least and the largest of them, and the labels."""
        line = b" " + b" ".join(words) + b" "
        starts, labels, n = [], set(), 0
        for phrase, _, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts.append(line.count(b" ", 0, at))
                labels.add(label)
                n += 1
                at = line.find(phrase, at + 1)
        return n, min(starts, default=None), max(starts, default=None), labels

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels whose key phrase stands at an alignment; the largest share of a template's
        words, weighted by IDF, that stand at a verified alignment."""
        postings = self.postings
        votes: Counter = Counter()
        for p, w in enumerate(words):
            if w in postings:
                for k, t in postings[w]:
                    votes[k, p - t] += 1
        labels, score = set(), 0.0
        for (k, at), n in votes.items():
            first, key = self.keys[k]
            if n < self.needed[k] or at + first < 0 or words[at + first : at + first + len(key)] != key:
                continue
            labels.add(self.labels[k])
            weights = [self.idf.get(w, 0.0) + 1e-9 for w in self.wording[k]]
            held = sum(x for i, (w, x) in enumerate(zip(self.wording[k], weights, strict=True)) if 0 <= at + i < len(words) and words[at + i] == w)
            score = max(score, held / sum(weights))
        return labels, min(score, 1.0)


def document_frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those with each licence word: at most one row per word of the templates."""
    vocabulary = index.vocabulary

    def run(batch):
        seen = Counter()
        for t in batch.column(1).to_pylist():
            seen.update(vocabulary.intersection(words_of(t)))
        seen[b""] = batch.num_rows
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = {bytes(r.word): r.n for r in per_batch(docs, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, rarest: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Document frequencies are counted over the whole table first. Null and empty texts have no
    words and no labels, with null places and score 0; null keys are kept; repeated rows each
    give a row; further columns are ignored; an empty table gives no rows. Words of equal
    IDF rank by their bytes. Texts are read whole.
    """
    rows = doc_texts(docs, text, key)
    index = Index(templates, phrases, rarest)
    index.with_counts(*document_frequencies(rows, index))

    def run(batch):
        columns = [[] for _ in range(7)]
        for t in batch.column(1).to_pylist():
            words = words_of(t)
            n, first, last, base = index.base(words)
            more, score = index.scan(words)
            for column, value in zip(columns, (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), max(score, 1.0 if base else 0.0)), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return per_batch(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
