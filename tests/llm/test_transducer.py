"""Operator 3: chunks' state maps and their scan against runs of one state at a time."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenstep.llm import queries, token_transducer
from evenstep.llm.token_transducer import BEFORE, HERE, NONE, OF_CLASS, WordSplitter

BYTE = queries.tokenizer("byte_bpe_50k.json")
END = OF_CLASS["end"]


def weight(starts, ends):
    """A figure that differs for every word."""
    return (np.asarray(starts) + 3) * 1000 + np.asarray(ends)


def one_run(splitter, chunk, state, before, base):
    """Exit state, begins and tokens of one chunk entered in one state, a character at a time."""
    places, previous = [], before
    for k, c in enumerate(chunk):
        marks = splitter.marks[state, c]
        places += [base + k - 1] * bool(marks & BEFORE) + [base + k] * bool(marks & HERE)
        if c == END and previous != END:
            places.append(base + k)
        state, previous = int(splitter.table[state, c]), c
    return state, places


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, END + 14), max_size=60), min_size=1, max_size=5), st.integers(1, 20))
def test_maps_and_their_scan(texts, width):
    splitter = WordSplitter(width)
    rows, depth = [], []
    for t in texts:
        classes = [c % 15 or 1 for c in t]
        n = len(classes) // width + 1
        rows.append(np.array(classes + [END] * (n * width - len(classes)), np.uint8).reshape(n, width))
        depth += range(n)
    chunks, depth = np.concatenate(rows), np.array(depth)
    before = np.where(depth == 0, END, np.append(0, chunks[:-1, -1])[: len(chunks)])
    maps = splitter.maps(chunks, before, weight)
    for i, chunk in enumerate(chunks):
        assert maps.able[i].any()
        for s in np.flatnonzero(maps.able[i]):
            state, places = one_run(splitter, chunk, s, before[i], i * width)
            assert places == sorted(places)
            assert maps.exits[i, s] == state
            assert (maps.first[i, s], maps.last[i, s]) == ((places[0], places[-1]) if places else (NONE, NONE))
            assert maps.tokens[i, s] == sum(weight(a, b) for a, b in zip(places, places[1:]))
    whole = splitter.scan(maps, depth, weight)
    state, places = 0, []
    for i, chunk in enumerate(chunks):
        if depth[i] == 0:
            state, places = splitter.start, []
        state, more = one_run(splitter, chunk, state, before[i], i * width)
        places += more
        assert whole.exits[i, splitter.start] == state
        assert whole.tokens[i, splitter.start] == sum(weight(a, b) for a, b in zip(places, places[1:]))


@pytest.mark.parametrize("width", [1, 2, 7, 64, 5000])
def test_counts_for_any_width(width):
    counter, library = token_transducer.TokenCounter(BYTE), Tokenizer.from_file(BYTE)
    counter.splitter = WordSplitter(width)
    rng = random.Random(width)
    parts = ["a", "'", "s", "'re", "'ll", " ", "  ", "\n", "é", "1", "!", "<|endoftext|>", "\0", "\x85", "the", "中", "ſ"]
    texts = ["", "\0", " ", "x" * 300, " " * 300, "'" * 200] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_rows(spark):
    """Null, empty and very long texts, ties, repeated rows, null keys, clashing names."""
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (4, "word  " * 100_000), (5, "z" * 200_000)]
    docs = spark.createDataFrame([(*r, 7, True) for r in rows], "doc_id long, text string, n_bytes int, over_limit boolean")
    library = Tokenizer.from_file(BYTE)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows]
    assert sorted(map(tuple, token_transducer.count_tokens(docs, BYTE).collect()), key=str) == sorted(want, key=str)
