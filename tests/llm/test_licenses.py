"""Operator 6: alignments and labels against brute force, base columns against SQL, odd rows."""

import random
import re
from collections import Counter
from math import log

import duckdb
import pytest

from evenstep.llm import license_scan, queries
from evenstep.llm.license_scan import PHRASES, TEMPLATES

_PLACES = "list_filter(range(1, len(w) - {n} + 2), lambda i: {same})"


def _places(phrase):
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return _PLACES.format(n=len(words), same=same)


BASE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(f"{_places(x)} AS p{k}" for k, x in enumerate(PHRASES))} FROM d),
a AS (SELECT *, flatten([{", ".join(f"p{k}" for k in range(len(PHRASES)))}]) AS places,
  list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(found)), ',') AS base_labels FROM a"""


def test_base_columns_in_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = queries.op6_license_scan(spark, sf).select(*names).collect()
    assert any(r.n_base for r in found)
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, found), key=key) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({BASE_SQL})").fetchall(), key=key)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(texts):
    """Every place of every key phrase: its label, and how much of the wording stands around it."""
    wording = [(label, words_of(t), words_of(p)) for label, t, p in TEMPLATES]
    vocabulary = {w for _, t, _ in wording for w in t}
    all_words = [words_of(t) for t in texts]
    df = Counter(w for words in all_words for w in set(words) & vocabulary)
    idf = {w: log((len(texts) + 1) / (df[w] + 1)) + 1e-9 for w in vocabulary}
    out = []
    for words in all_words:
        labels, score = set(), 0.0
        for label, t, key in wording:
            first = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
            for p in range(len(words) - len(key) + 1):
                if words[p : p + len(key)] == key:
                    labels.add(label)
                    held = sum(idf[w] for i, w in enumerate(t) if 0 <= p - first + i < len(words) and words[p - first + i] == w)
                    score = max(score, held / sum(idf[w] for w in t))
        line = " " + " ".join(words) + " "
        base = {label for phrase, label in PHRASES.items() if f" {phrase} " in line}
        out.append((",".join(sorted(base)), ",".join(sorted(base | labels)), max(min(score, 1.0), 1.0 if base else 0.0)))
    return out


def test_alignments_against_brute_force(spark):
    rng = random.Random(8)
    lone = [w for _, t, _ in TEMPLATES for w in words_of(t)]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(5)):
            words = words_of(rng.choice(TEMPLATES)[rng.choice((1, 1, 2))])
            a, b = sorted((rng.randrange(len(words) + 1), rng.randrange(len(words) + 1)))
            kind = rng.randrange(5)
            if kind == 0:
                words = words[a:b]
            elif kind == 1:
                words[a:a] = ["inserted"]
            elif kind == 2 and words:
                words[min(a, len(words) - 1)] = rng.choice(lone)
            parts += words + [rng.choice(lone) for _ in range(rng.randrange(4))]
        texts.append(rng.choice((" ", "\n# ", ", ")).join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in license_scan.scan_documents(rows).collect()}
    want = brute(texts)
    assert sum("," in labels for _, labels, _ in want) > 50
    for i, (base, labels, score) in enumerate(want):
        assert (found[i].base_labels, found[i].labels) == (base, labels), texts[i]
        assert found[i].score == pytest.approx(score)


REAL = {
    "# SPDX-License-Identifier: Apache-2.0": "apache-2",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    "/* SPDX-License-Identifier: BSD-3-Clause */": "bsd",
    " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 3 of the License, or\n": "gpl-3",
    "# under the terms of the GNU General Public License as published by the\n# Free Software Foundation; version 2 of the License.": "gpl-2",
    "GNU Lesser General Public License as published by the Free Software Foundation, either version 3": "lgpl",
    "the identifier of an spdx license is apache 2 0": "",
    "GNU General Public License": "",
}


def test_real_headers(spark):
    rows = spark.createDataFrame(list(enumerate(REAL)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_documents(rows).collect()} == dict(enumerate(REAL.values()))


def test_odd_rows(spark):
    """Null, empty and very long texts, ties, repeated rows, null keys, clashing names, empty tables."""
    mit = "Released under the MIT License"
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, mit), (4, "x " * 300_000 + mit + " y" * 300_000), (5, (mit + " ") * 3)]
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, labels string, score double").repartition(3)
    found = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan_documents(docs).collect())
    assert found == Counter({(1, 0, 0, None, None, "", ""): 1, (2, 0, 0, None, None, "", ""): 1, (3, 5, 1, 1, 1, "mit", "mit"): 2, (None, 5, 1, 1, 1, "mit", "mit"): 1, (4, 600_005, 1, 300_001, 300_001, "mit", "mit"): 1, (5, 15, 3, 1, 11, "mit", "mit"): 1})
    assert not license_scan.scan_documents(docs.where("false")).collect()
