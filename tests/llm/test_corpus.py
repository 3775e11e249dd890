"""Operators 2, 4, 5, 6, 9 and 10 and the pipeline against brute force."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter
from math import comb

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from evenstep.llm import block_naming, components, license_scan, quality, queries, simhash, toxicity, warc

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(sf, spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = "one two three four five " * 3000
    made = [None, "", " \n", "x", "x ", "a b", "A  b", "a\tb", long, long, long + "x", long.replace("five", "5ive", 1), "\x85a\xa0b", "é" * 2500]
    return found + [(5000 + i, t) for i, t in enumerate(made)] + [(7000, "twice"), (7000, "twice"), (None, "no key"), (None, "no key"), (7001, "no key")]


@pytest.fixture(scope="module")
def docs(rows, spark):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, kept string, fp int").repartition(3)


@pytest.mark.parametrize("block", [8, 64, 2048])
def test_exact_duplicates(block, docs, rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(d)
    want = Counter()
    for t, own in groups.items():
        least = min((d for d in own if d is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        stays = False
        for d in own:
            kept = d == least and not stays
            stays |= kept
            want[d, least, len(own), kept, sha] += 1
    assert Counter(map(tuple, block_naming.exact_duplicates(docs, block).collect())) == want


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        order = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want))


def brute_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    text = "three words here"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == simhash.signed(xxhash.xxh64_intdigest(text.encode(), 42))


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates(tile, docs, rows):
    prints = [brute_print(t) for _, t in rows]
    forest = components.Forest()
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                forest.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(forest.root(i), []).append(d)
    least = {r: min((d for d in own if d is not None), default=None) for r, own in least.items()}
    want = Counter((d, f"{p:016x}", least[forest.root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter(map(tuple, simhash.near_duplicates(docs, tile=tile).collect())) == want


def planted(n, seed):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for i in range(1, n, 2):
        for b in rng.sample(range(64), rng.randint(0, 5)):
            values[i] = values[rng.randrange(i)] ^ 1 << b if b % 7 == 0 else values[i - 1] ^ 1 << b
    return np.array(values, np.uint64)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(0, 5), st.integers(0, 10**6))
def test_bit_sliced_distances(n, radius, seed):
    values = planted(n, seed)
    apart = np.bitwise_count(values[:, None] ^ values[None])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if apart[i, j] <= radius}
    assert set(map(tuple, simhash.near_pairs(values, None, radius).tolist())) == want
    keys = np.arange(n) // 9
    assert set(map(tuple, simhash.small_buckets(keys, values, radius).tolist())) == {(i, j) for i, j in want if keys[i] == keys[j]}
    other = values[::-1][: n // 2]
    if len(other):
        assert set(map(tuple, simhash.near_pairs(values, other, radius).tolist())) == {(i, j) for i in range(n) for j in range(len(other)) if int(values[i] ^ other[j]).bit_count() <= radius}


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(differ & m == 0 for m in simhash.masks(3))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (rng.randrange(200, 260), rng.randrange(200, 260))] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, i) for i in range(501, 560)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {tuple(r) for r in components.connected_components(df).collect()} == {(x, forest.root(x)) for x in nodes}
    assert components.connected_components(df.where("false")).count() == 0


def test_license_base(docs, rows):
    found = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_documents(docs).collect()}
    want = set()
    for d, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.add((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert found == want


def test_license_templates(spark):
    made = {
        1: "Released under the MIT license. x x under the mit license",
        2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        3: "This file is covered by the GNU General Public License, version 3.",
        4: "the license of a general kind is public, gnu said in version 3",
        5: "CC-BY-NC text",
        6: None,
        7: "Redistribution and use in source and binary forms",
    }
    rows = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_documents(rows).collect()}
    assert {d: r.labels for d, r in found.items()} == {1: "mit", 2: "mit", 3: "gpl-3", 4: "", 5: "cc-by-nc", 6: "", 7: "bsd"}
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 1, 7)
    assert found[4].score == found[6].score == 0 and 0 < found[2].score < 1 and found[3].score == pytest.approx(1)
    assert not license_scan.scan_documents(rows.where("false")).collect()


def test_licenses_side_by_side(spark):
    """Every template whose key phrase stands in a file gives its label, whatever else is in the file."""
    wording = [(label, text) for label, text, _ in license_scan.TEMPLATES]
    made = {100 * i + j: f"{a} -- {b}" for i, (_, a) in enumerate(wording) for j, (_, b) in enumerate(wording)}
    want = {100 * i + j: ",".join(sorted({a, b})) for i, (a, _) in enumerate(wording) for j, (b, _) in enumerate(wording)}
    made |= {9000: "\n".join(t for _, t in wording), 9001: "\n".join(p for _, _, p in license_scan.TEMPLATES)}
    want |= dict.fromkeys((9000, 9001), ",".join(sorted({label for label, _ in wording})))
    rows = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_documents(rows).collect()} == want


def brute_features(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_features(rows):
    for t in ["a b c a b c", "a a a a a", "x\ny\nx\n \n \n", "é#é<b>\n\n"] + [t or "" for _, t in rows]:
        assert quality.features(t)[:5] == brute_features(t)


def test_binomial_bound():
    for n, k, p in ((10, 2, 0.3), (500, 3, 0.01), (40, 0, 0.05), (5, 5, 0.5)):
        assert quality.at_most(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_chosen_cutoffs_hold_their_risk():
    """Over many draws the share of good documents above the cutoff rarely exceeds alpha."""
    rng, broken, used = np.random.default_rng(0), 0, 0
    for _ in range(200):
        good = np.bincount(np.minimum(rng.geometric(0.05, 3000), 100), minlength=101)
        bad = np.bincount(rng.integers(20, 101, 500), minlength=101)
        c = quality.choose(good, bad, 0.01, 0.05, near_best=1.0, worth=0)
        if c is not None:
            used += 1
            broken += 0.95**c > 0.01
    assert used > 100 and broken <= 0.08 * used
    good, bad = np.array([5000, 0, 2, 0]), np.array([0, 0, 0, 15])
    assert quality.choose(good, bad, 0.01, 0.05) == 2  # the two good documents are not worth rejecting
    assert quality.choose(np.array([5000, 0, 0, 2]), bad, 0.01, 0.05) is None
    assert quality.choose(np.zeros(5, int), np.ones(5, int), 0.01, 0.05) is None
    assert quality.choose(np.array([100, 0, 0]), np.array([0, 0, 50]), 0.01, 0.05) is None  # too few to be certain


def test_quality_verdicts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(80))
    junk = lambda: " ".join(word() + "%%%" for _ in range(80))
    rows = [(i, clean(), "en") for i in range(3000)] + [(3000 + i, junk(), "en") for i in range(300)] + [(4000, "short", "en"), (4001, None, None), (4002, junk(), "fr"), (None, clean(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3300)] + [(None, 1), (1, 7)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.quality_verdicts(docs, labels).collect()}
    assert sum(not found[i].kept for i in range(3000)) <= 0.03 * 3000
    assert not any(found[i].kept for i in range(3000, 3300))
    assert found[4000].base_failed and found[4001].base_failed and not found[4000].kept
    assert found[4002].kept and found[None].kept  # no labels in that stratum: only base rules
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {d for d, r in found.items() if r.kept}
    none = quality.quality_verdicts(docs, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert not quality.quality_verdicts(docs.where("false"), labels).collect()


def test_small_strata_earn_cutoffs(spark):
    """Some 300 good holdouts a language are enough, however many rules there are."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    kinds = [word, lambda: word() + "%%%", lambda: word().upper()]
    rows = [(1000 * s + i, " ".join(kinds[0 if i < 330 else 1 + i % 2]() for _ in range(80)), lang) for s, lang in enumerate(("de", "fr", "es")) for i in range(370)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d % 1000 < 330)) for d, _, _ in rows], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality_verdicts(docs, labels).where("kept").collect()}
    for s in range(3):
        assert sum(1000 * s + i not in kept for i in range(330)) <= 0.03 * 330
        assert not any(1000 * s + i in kept for i in range(330, 370))


def test_joint_cutoffs_hold_their_risk():
    """Rules that each reject 2 % of good documents, 4 % together, rarely pass together at 3 %."""
    rng, both, one = np.random.default_rng(0), 0, 0
    path = [("symbols", 5), ("capitals", 5)]
    for _ in range(400):
        out = quality.accepted(path, rng.multinomial(2000, [0.02, 0.02, 0.96]), np.array([50, 50, 0]), 0.03, 0.05)
        both += len(out) == 2
        one += out == {"symbols": 5}
    assert both <= 0.08 * 400 and one > 200
    assert quality.accepted(path, np.array([0, 0, 900]), np.array([9, 0, 1]), 0.03, 0.05) == {"symbols": 5}  # catches no more
    assert quality.accepted(path, np.array([0, 0, 90]), np.array([9, 9, 1]), 0.03, 0.05) == {}  # too few to be certain
    assert set(quality.testable({"a": (50, 500), "b": (50, 150), "c": (50, 101)}, 0.03, 0.05)) == {"a", "b"}


def plain_marginals(field, tokens):
    """Forward and backward over every token, without shortcuts."""
    e = np.array([[1.0, np.exp(field.bias + (field.emission(t) or 0))] for t in tokens])
    move, n = np.exp(field.moves), len(tokens)
    total = np.zeros((n, 2))
    for path in range(1 << n):
        y = [path >> i & 1 for i in range(n)]
        p = np.prod([e[i, y[i]] for i in range(n)]) * np.prod([move[y[i - 1], y[i]] for i in range(1, n)])
        for i in range(n):
            total[i, y[i]] += p
    return total[:, 1] / total.sum(1)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["plain", "bad", "worse", "so"]), min_size=1, max_size=9), st.floats(-3, 1), st.integers(0, 100))
def test_marginals(tokens, bias, seed):
    moves = np.random.default_rng(seed).normal(size=(2, 2))
    field = toxicity.Field({"w:bad": 2.0, "4:wors": 1.0, "w:worse": 1.5}, bias, moves)
    hits = [(i, e) for i, t in enumerate(tokens) if (e := field.emission(t)) is not None]
    if hits:
        got = field.marginals([i for i, _ in hits], [e for _, e in hits], len(tokens))
        assert got == pytest.approx(plain_marginals(field, tokens)[[i for i, _ in hits]])


def test_gradient_expectations():
    rng = np.random.default_rng(0)
    emit, moves, mask = rng.normal(size=(4, 5)), rng.normal(size=(2, 2)), np.arange(5)[None] < np.array([5, 3, 1, 4])[:, None]
    p1, pairs = toxicity._expectations(emit, moves, mask)
    total = np.zeros((2, 2))
    for r in range(4):
        n = int(mask[r].sum())
        weights = {}
        for path in range(1 << n):
            y = [path >> i & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(emit[r, i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
        z = sum(weights.values())
        for y, w in weights.items():
            for i in range(1, n):
                total[y[i - 1], y[i]] += w / z
        assert p1[r, :n] == pytest.approx([sum(w for y, w in weights.items() if y[i]) / z for i in range(n)])
    assert pairs == pytest.approx(total)


def test_toxicity_learns(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(40)], i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Zorkish,", "zorkly", "ZORKEN!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "a zorky day")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, 9)], "doc_id long, toxic int")
    field = toxicity.train(docs, marks)
    found = {r.doc_id: r for r in toxicity.score_documents(docs, field, with_spans=True).collect()}
    for i, toxic in labels:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert found[i].predicted == toxic
        assert 0 <= found[i].score <= 1
        if toxic:
            assert [rows[i][1][s.start : s.end].lower()[:4] for s in found[i].spans] == ["zork"]
    assert found[9000].score == found[9001].score == 0 and not found[None].held_out and found[None].predicted == 1
    assert {r.doc_id for r in toxicity.drop_toxic(docs, field).collect()} == {d for d, r in found.items() if not r.predicted}
    blind = toxicity.train(docs, marks.where("false"))
    assert {r.score for r in toxicity.score_documents(docs, blind).collect()} == {0.0}
    assert not toxicity.score_documents(docs.where("false"), field).collect()


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels)) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    assert len(toxicity.training_rows(docs, labels, 5, 7)) == 12


def test_toxicity_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    found = queries.op10_toxicity(spark, big).where("held_out").join(labels, "doc_id").collect()
    right = [r for r in found if r.predicted == r.toxic]
    assert len(right) > 0.95 * len(found)
    assert sum(r.predicted for r in found if not r.toxic) <= 0.01 * len(found)


def whole_file(blocks):
    return b"".join(warc.record("resource", {"WARC-Record-ID": f"<urn:x:{i}>"}, b) for i, b in enumerate(blocks))


@pytest.mark.parametrize("members", ["one", "each", "odd"])
def test_normaliser(members):
    blocks = [b"", b"x" * 10, b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 9000]
    data = whole_file(blocks)
    cut = {"one": [data], "each": [whole_file([b]) for b in blocks], "odd": [data[:7], data[7:5000], b"", data[5000:]]}[members]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(b"".join(map(gzip.compress, cut))), out)
    assert len(index) == len(blocks)
    for entry, b in zip(index, blocks, strict=True):
        member = out.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
        assert warc.read_record(io.BytesIO(gzip.decompress(member)))[2] == b
    assert sum(e["length"] for e in index) == len(out.getvalue())


def test_normaliser_of_broken_files():
    data = gzip.compress(whole_file([b"x" * 5000]))
    for broken in (data[:-20], gzip.compress(b"nothing"), gzip.compress(whole_file([b"abc"])[:-6])):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(broken), io.BytesIO())
    assert warc.normalise(io.BytesIO(b""), io.BytesIO()) == []


def test_archives(spark):
    body, short = "é" * 600, "s" * 999
    made = [(1, "http://a/ b\r\nX: y", body), (5, "u", body), (3, None, body), (7, "u", short), (8, "u", short), (9, "u", None), (10, "u", ""), (None, "u", body), (11, "u", "t" * 1000), (11, "u", "t" * 1000), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    pages = spark.createDataFrame([(*r, "x") for r in made], "page_id long, url string, html string, sha256 string").repartition(3)
    found = Counter(map(tuple, warc.read_archives(spark, warc.write_archives(pages)).collect()))
    want = Counter()
    for p, _, html in made:
        data = (html or "").encode()
        origin = max((q for q, _, h in made if (h or "").encode() == data and q is not None), default=None) if len(data) >= 1000 else None
        revisit = origin is not None and origin != p
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", origin if revisit else None] += 1
    assert found == want
    assert not warc.read_archives(spark, warc.write_archives(pages.where("false"))).collect()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= n
        n = docs.count()


def test_pipeline_is_its_operators(spark, sf):
    """Each stage against its operator's verdicts on the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    calm = {r.doc_id for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect() if not r.predicted}
    docs = docs.where(docs.doc_id.isin(list(calm)))
    good = {r.doc_id for r in quality.quality_verdicts(docs, labels).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(list(good)))
    first = {r.doc_id for r in block_naming.exact_duplicates(docs).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(list(first)))
    last = {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id}
    assert ids(corpus_pipeline.run(spark, sf)) == last


def test_copy_stages_with_repeated_rows(docs, spark, sf):
    kept = corpus_pipeline.remove_copies(spark, docs, sf)
    texts = [SPACE.sub(" ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {SPACE.sub(" ", r.text or "") for r in docs.collect()}
    near = corpus_pipeline.remove_near_copies(spark, docs.where("doc_id is not null"), sf).collect()
    groups = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert sorted(r.doc_id for r in near) == sorted({r.component_id for r in groups})


def test_near_copies_with_null_and_repeated_ids(spark, sf):
    """One row of every component stays, also where a doc_id is null or stands at several texts."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2].upper()), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (None, texts[4]), (6, texts[5]), (2, texts[5].title()), (None, texts[6]), (None, texts[6])]
    made = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, kept string, fp int").repartition(3)
    near = corpus_pipeline.remove_near_copies(spark, made, sf)
    found = sorted(((r.doc_id or 0, r.text.lower()) for r in near.collect()))
    assert near.columns == made.columns
    assert found == sorted([(0, texts[0]), (0, texts[1]), (0, texts[2]), (5, texts[3]), (5, texts[4]), (2, texts[5]), (0, texts[6])])
