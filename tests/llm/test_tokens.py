"""Operators 1, 3, 7 and 8 against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenstep.llm import bpe, packing, queries, token_files, token_transducer
from evenstep.llm.common import open_shared

WORD, BYTE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
PIECES = ["a", "'", "s", "re", "'ll", "T", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "é", "é", "1", "23", "!", "　", "中", "\x1f", "\x85", "\xa0", "Σ", "İ", "\U0001f600", "\x00", "the", "ing", "ß"]
ODD = ["", " ", "\n", "<|endoftext|>a <|endoftext|>", " " * 3000 + "x", "a" * 5000, "\0a\0\0 b", "it's 're're''s !'s  's\n's", "aaaa" * 300, "<|ENDOFTEXT|>", "x\x1cy"]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    return ODD + ["".join(pick.choice(PIECES) for _ in range(pick.randint(1, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def rows(texts, sf, spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return found + [(10_000 + i, t) for i, t in enumerate(texts[:300])] + [(20_000, None), (None, "null key"), (10_000, "again"), (10_000, "again")]


@pytest.fixture(scope="module")
def docs(rows, spark):
    """Further columns have names that the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)


def ids_of(path):
    library = Tokenizer.from_file(path)
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


def test_word_encoder(texts):
    own, library, want = bpe.WordEncoder(WORD), Tokenizer.from_file(WORD), ids_of(WORD)
    at, chunks = own.places(texts)
    flat, bounds = own.gather(at, chunks)
    for k, t in enumerate(texts):
        ids = want(t)
        assert flat[bounds[k] : bounds[k + 1]].tolist() == ids
        assert own.decode(at[chunks[k] : chunks[k + 1]]) == own.decode_ids(ids) == library.decode(ids, skip_special_tokens=False)
    ended, bounds = own.encode_batch(texts, 1)
    assert [ended[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*want(t), 1] for t in texts]


def test_word_encoder_forgets(texts):
    own, want = bpe.WordEncoder(WORD, most=50), ids_of(WORD)
    for t in texts[:200] + texts[:200]:
        assert own.encode_batch([t])[0].tolist() == want(t)


def slow_merges(symbols, ranks):
    symbols = list(symbols)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=5), st.permutations(["aa", "ab", "bc", "aab", "abc", "aaa"]))
def test_merge_rounds_of_any_order(words, made):
    """Also of merges that make pairs of lower rank, which must go one at a time."""
    merges = [[m[0], m[1:]] for m in made if len(m) == 2] + [[m[:2], m[2:]] for m in made if len(m) == 3]
    merges.sort(key=lambda m: made.index("".join(m)))
    vocab = {t: i for i, t in enumerate([*"abc", *made])}
    table = bpe.MergeTable({"model": {"vocab": vocab, "merges": merges}})
    ids, starts = table.encode([w.encode() for w in words])
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    for k, w in enumerate(words):
        assert ids[starts[k] : starts[k + 1]].tolist() == [vocab[x] for x in slow_merges(w, ranks)]


def test_digests(docs, rows):
    want, library = ids_of(WORD), Tokenizer.from_file(WORD)
    expected = []
    for d, t in rows:
        ids = want(t)
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encoding_digests(docs, WORD).collect()), key=str) == sorted(expected, key=str)
    whole = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_documents(docs.where("doc_id < 50"), WORD).collect()}
    for d, t in rows:
        if d is not None and d < 50:
            assert whole[d] == (want(t), library.decode(want(t), skip_special_tokens=False))


def test_transducer(texts):
    counter, want = token_transducer.TokenCounter(BYTE), ids_of(BYTE)
    assert counter.counts(texts) == [len(want(t)) for t in texts]
    assert [counter.counts([t])[0] for t in texts[:100]] == [len(want(t)) for t in texts[:100]]


def test_transducer_forgets(texts):
    counter, want = token_transducer.TokenCounter(BYTE, most=20), ids_of(BYTE)
    counter.machine.most = 10
    assert [counter.counts([t])[0] for t in texts[:150]] == [len(want(t)) for t in texts[:150]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, len(token_transducer.CLASSES) - 1), max_size=200), st.integers(1, 9))
def test_chunk_maps_compose(classes, width):
    """Chunks of any width give the boundaries of one pass."""
    row = np.array(classes, np.uint8)
    one = token_transducer.WordSplitter(max(len(classes), 1)).begins(row)
    assert token_transducer.WordSplitter(width).begins(row).tolist() == one.tolist()


def test_counts(docs, rows):
    want = ids_of(BYTE)
    expected = [(d, len((t or "").encode()), n := len(want(t)), n > 512) for d, t in rows]
    assert sorted(map(tuple, token_transducer.count_tokens(docs, BYTE).collect()), key=str) == sorted(expected, key=str)


def test_pack_lengths():
    pick = random.Random(2)
    for _ in range(40):
        lengths = np.array([pick.choice([1, 2, 50, 300, 2047, 2048, 2049, 9000, pick.randint(1, 4000)]) for _ in range(pick.randint(0, 60))], np.int64)
        limits = dict(segments=pick.choice([2, 5, 256]), loss=pick.choice([500, 2048]), lossless=pick.choice([0, 1]))
        seen = defaultdict(list)
        for sequence in packing.pack_lengths(lengths, **limits):
            assert sequence and sum(n for _, _, n in sequence) <= 2048 and len(sequence) <= limits["segments"]
            assert sum(max(n - limits["lossless"], 0) for _, _, n in sequence) <= limits["loss"]
            for d, at, n in sequence:
                assert n > 0
                seen[d].append((at, n))
        for d, total in enumerate(lengths.tolist()):
            at = 0
            for start, n in sorted(seen[d]):
                assert start == at
                at += n
            assert at == total


def test_dot_product_prefers_what_fits_the_room():
    """A room that is long in tokens and short in segments takes the long example, not the short ones."""
    items = np.array([[1000, 1, 0], [900, 1, 0], [10, 1, 0], [10, 1, 0]])
    bins = packing.dot_product_packing(items, np.array([2000, 2, 100]))
    assert sorted(map(sorted, bins)) == [[0, 1], [2, 3]]


def test_pack(docs, rows):
    want = ids_of(BYTE)
    found = packing.pack_documents(docs, BYTE).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 3 * 64
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for d, own in texts.items():
        if len(own) == 1:
            ids, at = np.array([*want(own[0]), 1], "<u4"), 0
            for start, n, crc, total in sorted(pieces[d]):
                assert start == at and total == len(ids)
                assert crc == zlib.crc32(ids[start : start + n].tobytes())
                at += n
            assert at == len(ids)
        else:
            assert sum(n for _, n, _, _ in pieces[d]) == sum(len(want(t)) + 1 for t in own)


def test_token_files(docs, rows, spark):
    want = ids_of(WORD)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id <> 10000")
    for encoding in ("dictionary", "delta"):
        files = token_files.write_tokens(unique, WORD, encoding=encoding, group_tokens=20_000)
        found = {r.doc_id: r for r in token_files.read_tokens(spark, files, with_ids=True).collect()}
        start = 0
        for d, t in sorted((d, t) for d, t in rows if d is not None and d != 10_000):
            ids = [*want(t), 1]
            assert (found[d].start, found[d].n_tokens, found[d].ids) == (start, len(ids), ids)
            assert found[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
        filesystem, name = open_shared(files.first().file)
        meta = pq.ParquetFile(filesystem.open_input_file(name)).metadata
        column = meta.row_group(0).column(2)
        assert column.has_column_index or column.has_offset_index
        assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
        assert ("RLE_DICTIONARY" in column.encodings) == (encoding == "dictionary")
    everything = token_files.read_tokens(spark, token_files.write_tokens(docs, WORD)).collect()
    assert len(everything) == len(rows)
    at = 0
    for r in sorted(everything, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_tables(docs, spark):
    none = docs.where("false")
    assert not packing.pack_documents(none, BYTE).collect()
    assert not token_transducer.count_tokens(none, BYTE).collect()
    assert not bpe.encoding_digests(none, WORD).collect()
    assert not token_files.read_tokens(spark, token_files.write_tokens(none, WORD)).collect()
