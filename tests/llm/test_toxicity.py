"""Operator 10: statistics, pieces and verdicts against brute force; recall by language."""

import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenstep.llm import queries, toxicity


def test_recall_by_language(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs = queries.table(spark, big, "documents")
    labels = queries.table(spark, big, "labels").select("doc_id", "toxic")
    found = queries.op10_toxicity(spark, big).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    toxic, caught, clean, wrong = Counter(), Counter(), Counter(), Counter()
    for r in found:
        (toxic if r.toxic else clean)[r.lang] += 1
        (caught if r.toxic else wrong)[r.lang] += r.predicted
        assert bool(r.spans) or not r.predicted
        for s in r.spans:
            assert toxicity._TOKEN.fullmatch(r.text[s.start : s.end]) and 0.5 <= s.probability <= 1
    assert len(toxic) == 4
    for lang in toxic:
        assert caught[lang] >= 0.9 * toxic[lang], lang
        assert wrong[lang] <= 0.01 * clean[lang], lang


def test_feature_counts(spark):
    rng = random.Random(1)
    words = ["Zork", "zorkish", "ab", "it's", "Ünder", "x"]
    rows = [(rng.randrange(12), rng.randrange(2), " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for _ in range(60)]
    most: dict = {}
    for g, toxic, text in rows:
        own = Counter(f for t in text.split() for f in toxicity.token_features(t))
        for f, n in own.items():
            most[g, toxic, f] = max(n, most.get((g, toxic, f), 0))
    want: dict = {}
    for (_, toxic, f), n in most.items():
        for j, times in enumerate(toxicity.TIMES):
            want.setdefault(f, [0] * 6)[(0 if toxic else 3) + j] += n >= times
    df = spark.createDataFrame([(*r, 0) for r in rows], "grp int, toxic int, text string, feature int")
    for limit in (3, 500_000):
        assert {r.feature: list(r)[1:] for r in toxicity.feature_counts(df, limit).collect()} == want
    # some groups in parts
    parted = spark.createDataFrame([(*r, i % 3 if r[0] % 2 else None) for i, r in enumerate(rows)], "grp int, toxic int, text string, part int")
    assert {r.feature: list(r)[1:] for r in toxicity.feature_counts(parted, 3).collect()} == want


def test_beyond_doubt(spark):
    from pyspark.sql import functions as F

    cases = [(k, n) for n in (3, 10, 40, 200) for k in {0, 1, 3, n // 2, int(0.75 * n), n - 1, n} if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("sure", toxicity.beyond_doubt(F.col("k"), F.col("n"), 0.1, 1000)).collect()
    for r in rows:
        s = r.k / r.n
        apart = (s * log(s / 0.1) if s else 0) + ((1 - s) * log((1 - s) / 0.9) if s < 1 else 0)
        assert r.sure == (r.k >= 3 and s >= toxicity.LEAST_SHARE and r.n * apart > log(1000 / 0.01))
    assert {r.sure for r in rows} == {True, False}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 120)), st.integers(121, 130))
def test_pieces(places, n):
    found = toxicity.pieces(sorted(places), n)
    held = Counter(i for a, b in found for i in range(a, b))
    assert all(held[i] == 1 for i in places) and set(held.values()) <= {1}
    assert all(0 <= a < b <= n and b - a <= toxicity.SPAN for a, b in found)
    assert all(any(abs(i - p) <= toxicity.AROUND for p in places) for i in held)


def test_verdicts_rise_with_toxic_tokens():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        toxic = int(rng.random() < 0.3)
        n = int(rng.integers(50, 2000))
        rows.append((n, 1 + rng.poisson(5 if toxic else 0.001 * n), toxic, 1.0))
    b = toxicity.fit_verdict(rows)
    p = lambda n, s: 1 / (1 + exp(-np.dot(b, toxicity.totals(n, s))))
    assert b[1] >= 0 and b[2] >= 0
    assert p(1800, 2) < 0.5 < p(100, 6) and p(500, 1) < p(500, 3) < p(500, 9)
    assert sum((p(n, s) >= 0.5) == bool(t) for n, s, t, _ in rows) > 0.85 * len(rows)
    assert toxicity.fit_verdict([]) == (0.0, 1.0, 0.0)
    assert min(toxicity.fit_verdict([(10, 5.0, 0, 1.0), (10, 1.0, 1, 1.0)])[1:]) >= 0


def test_passing_mention_is_no_verdict(spark):
    """A word that clean documents hold once, by chance, marks those that hold it several times."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [word() for _ in range(60)]
        for at in rng.sample(range(60), rng.randint(3, 6) if toxic else rng.random() < 0.25):
            words[at] = "zork" + word()[:2]
        rows.append((i, ", ".join(words), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    field = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, field).collect()}
    assert sum(found[i] != t for i, t in labels) <= 9


def test_odd_rows(spark):
    """Null, empty, very long, repeated, joined-up and marked-up texts; ties; clashing names; empty tables."""
    field = toxicity.Field({"w:zork": 9.0}, -4.0, verdict=(3.0, 1.0, 0.0))
    rows = [(1, None), (2, ""), (3, "zork"), (3, "zork"), (None, "Zork!"), (4, "<b>zork</b> a/zork so-zork"), (5, "plain " * 50_000 + "zork"), (6, "zorkzork"), (7, "\U0001f600 zork")]
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t in rows], "doc_id long, text string, score double, spans string").repartition(3)
    found = toxicity.score_documents(docs, field, with_spans=True)
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "spans"]
    got = Counter((r.doc_id, r.predicted, tuple((s.start, s.end) for s in r.spans)) for r in found.collect())
    assert got == Counter({(1, 0, ()): 1, (2, 0, ()): 1, (3, 1, ((0, 4),)): 2, (None, 1, ((0, 4),)): 1, (4, 1, ((3, 7), (14, 18), (22, 26))): 1, (5, 1, ((300_000, 300_004),)): 1, (6, 0, ()): 1, (7, 1, ((2, 6),)): 1})
    kept = toxicity.drop_toxic(docs, field)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert not toxicity.drop_toxic(docs.where("false"), field).collect()
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    for d, marks in ((docs, labels), (docs.where("false"), labels), (docs, labels.where("false"))):
        assert {r.score for r in toxicity.score_documents(docs, toxicity.train(d, marks)).collect()} == {0.0}


@pytest.mark.parametrize("copies", [1, 5])
def test_copies_are_one_witness(spark, copies):
    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "else words stand in this text that is like no other"]
    groups = toxicity.copy_groups([toxicity.least_hashes(t) for t in texts * copies])
    assert len(set(groups)) == 2 and groups[0] == groups[1] != groups[2]
