"""Operator 1: limits that bind, prompts, long and odd texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenstep.llm import packing, queries

BYTE = queries.tokenizer("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=40), st.integers(8, 120), st.integers(1, 6), st.integers(4, 120), st.integers(0, 3), st.sampled_from([1, 4, 64]))
def test_limits_hold(docs, most, segments, loss, lossless, tail):
    lengths, prompts = np.array([n for n, _ in docs], np.int64), np.array([p for _, p in docs], np.int64)
    held = defaultdict(list)
    for sequence in packing.pack_lengths(lengths, most, segments, loss, lossless, tail, prompts):
        assert 0 < len(sequence) <= segments and sum(n for *_, n in sequence) <= most
        # token by token: what bears loss
        assert sum(i >= prompts[d] and i - at >= lossless for d, at, n in sequence for i in range(at, at + n)) <= loss
        for d, at, n in sequence:
            held[d] += range(at, at + n)
    for d, n in enumerate(lengths.tolist()):
        assert sorted(held[d]) == list(range(n))


def slow_packing(items, limits):
    """The dot-product rule item by item, equal vectors in the order of their numbers."""
    left, bins = list(range(len(items))), []
    share = items / limits
    scaled = share * (share.sum(0) / max(share.sum(), 1e-12))
    while left:
        room, own = limits.copy(), []
        k = max(left, key=lambda i: (scaled[i].sum(), [-x for x in items[i]], -i))
        while k is not None:
            own.append(k)
            left.remove(k)
            room = room - items[k]
            fits = [i for i in left if (items[i] <= room).all()]
            k = max(fits, key=lambda i: (round(float(scaled[i] @ (room / limits)), 12), [-x for x in items[i]], -i), default=None)
        bins.append(own)
    return bins


def test_every_dimension_decides():
    """The rule in three dimensions, and that it packs otherwise than by tokens alone."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 900, 60)
    items = np.stack([n, np.ones_like(n), (n * rng.random(60)).astype(int)], 1)
    limits = np.array([2048, 6, 900])
    bins = packing.dot_product_packing(items, limits)
    counts = lambda bins, d: [int(items[own, d].sum()) for own in bins]
    assert counts(bins, 0) == counts(slow_packing(items, limits), 0)
    assert all((items[own].sum(0) <= limits).all() for own in bins) and sorted(sum(bins, [])) == list(range(60))
    by_tokens = packing.dot_product_packing(items[:, :1], limits[:1])
    assert set(map(frozenset, bins)) != set(map(frozenset, by_tokens))
    assert any((items[own].sum(0) > limits).any() for own in by_tokens)


def test_limits_bind_in_the_query(spark, sf):
    rows = queries.op1_packing(spark, sf).collect()
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append(r)
    loss = [sum(r.loss_tokens for r in s) for s in own.values()]
    tokens = [sum(r.length for r in s) for s in own.values()]
    assert max(loss) == 2040 and sum(x == 2040 for x in loss) > 0.1 * len(own)
    assert max(map(len, own.values())) <= 12 and max(tokens) == 2048
    padding = sum(2048 - n for n in tokens if n & (n - 1))
    assert padding <= 0.005 * sum(tokens)


@pytest.mark.parametrize("text", ["first\nsecond line", "one line only", "\n\nafter breaks", "é中\nß <|endoftext|>\nx", "<|endoftext|>\n", "", "a  \n  b"])
def test_prompt_tokens(text):
    library = Tokenizer.from_file(BYTE)
    ids = library.encode(text, add_special_tokens=False)
    n = packing.first_line(text)
    ends = [b for _, b in ids.offsets]
    want = sum(len(text[:b].encode()) <= len(text[:n].encode()) for b in ends) if n else 0
    sizes = packing.token_bytes(BYTE)
    assert sizes[ids.ids].sum() == len(text.encode())
    got = packing.leading_tokens(np.array(ids.ids, np.uint32), sizes, len(text[:n].encode()))
    assert got == want


def test_engines_agree_on_long_texts():
    """Texts on either side of the length and of the characters that decide which library encodes."""
    encode, library = packing.byte_encoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    words = ["the ", "ing\n", "  é", "123 ", "it's ", "<|endoftext|>"]
    for extra in ("", "ͯ", "Ͱ", "中"):
        for size in (1 << 17, (1 << 17) + 1, 400_000):
            text = ("".join(rng.choice(words) for _ in range(size // 4)) + "x" * size)[: size - len(extra)] + extra
            assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    """Null, empty and very long texts, ties, repeated rows, null keys, clashing names."""
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (4, "line\n" + "word " * 60_000)]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, length int, sequence_id string").coalesce(1)
    found = packing.pack_documents(docs, BYTE, segments=3, loss=2000, prompt=packing.first_line).collect()
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
    want = Counter()
    library = Tokenizer.from_file(BYTE)
    for d, t in rows:
        want[d] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want
    assert not packing.pack_documents(docs.where("false"), BYTE, prompt=packing.first_line).collect()
