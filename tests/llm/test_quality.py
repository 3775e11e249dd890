"""Operator 9: verdicts against a second version, base columns against SQL, odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import comb, log

import duckdb
import pytest
import xxhash

from evenstep.llm import quality, queries, witnesses
from evenstep.llm.components import Forest

BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, range(3) AS x(o) WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN r USING (doc_id)"""


def test_base_columns_in_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = queries.op9_quality(spark, sf).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({BASE_SQL})").fetchall())


def hashed(x):
    h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_figures(text):
    n_words, chars, symbols, dup, repeats, lines, capitals, marks = quality.features(text)
    share = {"symbols": (symbols, chars), "capitals": (capitals, chars), "marks": (marks, chars), "dup_lines": (dup, lines), "repeats": (repeats, n_words), "length": (chars, n_words)}
    return {r: min(int(a / max(b, 1) * (10 if r == "length" else 500)), 1000) for r, (a, b) in share.items()}


def tail(k, n, p):
    p = Fraction(p).limit_denominator()
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def plain_cutoffs(rows, labels, alpha, delta):
    """The whole choice by its definition: lists and loops."""
    label = {}
    for d, q in labels:
        if d is not None and q in (0, 1):
            label[d] = min(q, label.get(d, 1))
    held = [(d, t, s or "") for d, t, s in rows if d in label and not base_failed(t)]
    forest, first = Forest(), {}
    for d, t, _ in held:
        least = witnesses.least_hashes(t)
        for b in range(witnesses.BANDS):
            forest.join(first.setdefault((b, *least[2 * b : 2 * b + 2]), d), d)
    ones = {}
    for d, t, s in held:
        key = forest.root(d), label[d]
        ones[key] = min((hashed(d), d, s, t), ones.get(key, (1 << 64, 0, "", "")))
    parts = {}
    for (g, q), (_, _, s, t) in ones.items():
        part = 0 if not q else 1 if hashed(g) % 3 == 0 else 2
        parts.setdefault(s, ([], [], []))[part].append(plain_figures(t))
    able = {s: p for s, p in parts.items() if p[1] and len(p[2]) >= int(log(delta) / log(1 - alpha))}
    order = sorted(able, key=lambda s: (-len(able[s][2]), s))
    count = max((i for i, s in enumerate(order, 1) if len(able[s][2]) >= log(delta / i) / log(1 - alpha)), default=0)
    out = {}
    for s in order[:count]:
        bad, seen, tests = able[s]
        scale = (len(seen) + len(tests)) / len(seen)
        found = []
        for at, rule in enumerate(quality.RULES):
            table = []
            for c in range(1001):
                k, caught = sum(f[rule] > c for f in seen) * scale, sum(f[rule] > c for f in bad)
                table.append((c, k, caught))
            for level in (0, 1):
                good = [(c, k, n) for c, k, n in table if n >= 3 and (k == 0 if not level else k <= alpha * len(seen) * scale and n >= 10 * k)]
                if good:
                    best = max(n for _, _, n in good)
                    c, k, n = max(x for x in good if x[2] >= 0.98 * best)
                    found.append((level, k if level else -(c + 1) / (good[0][0] + 1), -n, at, rule, c))
        path = []
        for *_, rule, c in sorted(found):
            if all(c < d for r, d in path if r == rule):
                path.append((rule, c))
        kept = {}
        for i, (rule, c) in enumerate(path, 1):
            rejects = lambda f, upto: any(f[r] > x for r, x in path[:upto])
            if tail(sum(rejects(f, i) for f in tests), len(tests), alpha) > delta / count:
                break
            if sum(rejects(f, i) for f in bad) > sum(rejects(f, i - 1) for f in bad):
                kept[rule] = c
        out[s] = kept
    return out


def base_failed(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def made_rows(seed=0):
    """Documents of four strata with several faults, near copies with equal and with unlike labels."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    faults = [lambda w: w + "%%", str.upper, lambda w: w + "!!", lambda w: w * 5]
    rows, labels = [], []
    for s, (lang, n) in enumerate((("en", 700), ("de", 400), (None, 330), ("fr", 60))):
        for i in range(n):
            d, words = 10_000 * s + i, [word() for _ in range(70)]
            bad = i % 9 == 0
            fault = rng.choice(faults)
            words = [fault(w) if bad or rng.random() < 0.02 else w for w in words]
            if rows and rng.random() < 0.15:
                words = rng.choice(rows)[1].split()[:]
                words[5] = word()
            rows.append((d, " ".join(words), lang))
            labels.append((d, int(not bad)))
    return rows, labels


@pytest.mark.parametrize("broadcast", [quality.MOST_BROADCAST, 10])
def test_verdicts_against_a_second_version(spark, broadcast, monkeypatch):
    rows, labels = made_rows()
    monkeypatch.setattr(quality.holdouts, "__defaults__", (broadcast,))
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, quality int, stratum int")
    marks = spark.createDataFrame(labels + [(3, 0), (None, 0), (99, 1)], "doc_id long, quality int")
    want = plain_cutoffs(rows, labels + [(3, 0), (None, 0)], 0.03, 0.05)
    assert sum(map(len, want.values())) >= 4 and "fr" not in want
    assert quality.thresholds(docs, marks) == want
    kept = {}
    for d, t, s in rows:
        rules = want.get(s or "", {})
        kept[d] = (not base_failed(t) and all(plain_figures(t)[r] <= c for r, c in rules.items()), ",".join(f"{r}>{c}" for r, c in sorted(rules.items())))
    assert {r.doc_id: (r.kept, r.cutoffs) for r in quality.quality_verdicts(docs, marks).collect()} == kept


def test_near_copies_are_one_holdout(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(100 * i + j, t + f" {j}", "en") for i, t in enumerate(texts) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d % 100 < 5)) for d, _, _ in rows], "doc_id long, quality int")
    assert Counter(r.part == 0 for r in quality.holdouts(docs, labels).collect()) == {True: 40, False: 40}


def test_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, null keys and strata, clashing names, empty tables."""
    long = " ".join(f"w{i % 997}x{i}" for i in range((1 << 20) + 50))
    rows = [(1, None, "en"), (2, "", None), (3, "a b " * 60, "en"), (3, "a b " * 60, "en"), (None, " ".join(map(str, range(60))), None), (4, long, "en"), (5, long + " " + long[:200], "de")]
    docs = spark.createDataFrame([(*r, True, "x") for r in rows], "doc_id long, text string, lang string, kept boolean, stratum string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    found = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept, r.cutoffs) for r in quality.quality_verdicts(docs, labels).collect())
    n = (1 << 20) + 50
    words = (long + " " + long[:200]).split()
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for k in range(3)}
    assert found == Counter({(1, 0, 0, True, False, ""): 1, (2, 0, 0, True, False, ""): 1, (3, 120, 120, True, False, ""): 2, (None, 60, 0, False, True, ""): 1, (4, n, 0, False, True, ""): 1, (5, len(words), len(again), False, True, ""): 1})
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5]
    assert not quality.quality_verdicts(docs.where("false"), labels).collect() and not quality.keep_good(docs.where("false"), labels).collect()
