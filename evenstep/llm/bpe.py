"""Byte-pair encoding by batched merge rounds over flat numpy arrays, and decoding.

The symbols of many words stand in one flat array. A round looks up every adjacent pair by
binary search over the sorted pair keys, finds each word's lowest rank, and merges it.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evenstep.llm.common import doc_texts, per_batch

NO_RANK = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class MergeTable:
    """A tokenizer file's vocabulary and merges as arrays: keys, ranks and results of pairs."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        prefix = model.get("continuing_subword_prefix") or ""
        if prefix or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("continuing prefixes, ignore_merges and dropout are not supported")
        chars = byte_characters()
        self.inner = np.array([self.vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([self.vocab.get(c + suffix, -1) for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        # two ids make a key; half the bytes where ids have 16 bits
        small = max(self.vocab.values(), default=0) < 1 << 16
        self.shift, self.key = (16, np.uint32) if small else (21, np.int64)
        keys = (left << self.shift | right).astype(self.key)
        order = np.argsort(keys, kind="stable")
        # of a pair that is listed twice the later rank holds, as in a map filled in order
        keep = np.append(keys[order][1:] != keys[order][:-1], True) if len(order) else np.zeros(0, bool)
        self.order = order[keep]
        self.base = np.unique(np.concatenate([self.inner, self.last]))
        self.keys, self.ranks, self.made = keys[self.order], self.order.astype(np.int32), made[self.order].astype(np.int32)
        born = {}
        self.steady = True
        for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True)):
            if c in born or born.get(a, -1) >= rank or born.get(b, -1) >= rank:
                self.steady = False
            born[c] = rank
        # what the binary search gives for pairs of single bytes, looked up once
        self.place_of = np.full(int(self.base[-1]) + 1, -1, np.int64)
        self.place_of[self.base[self.base >= 0]] = np.flatnonzero(self.base >= 0)
        grid = np.maximum(self.base, 0).astype(self.key)
        grid = grid[:, None] << self.key(self.shift) | grid[None, :]
        self.base_rank, self.base_made = np.full(grid.shape, NO_RANK, np.int32), np.zeros(grid.shape, np.int32)
        hit, place = self.find(grid.ravel())
        self.base_rank.ravel()[hit], self.base_made.ravel()[hit] = self.ranks[place], self.made[place]
        self.pairs = list(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids start (one entry more than words)."""
        return self.encode_flat(b"".join(words), np.fromiter(map(len, words), np.int64, len(words)))

    def encode_flat(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of words that stand one after the other in data.

        An empty word has no ids. Where merges are steady (a merge never makes a pair of lower
        rank) all places of a word's lowest pair merge in one round, else the leftmost alone.
        """
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        full = lengths > 0
        symbols[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        known = symbols >= 0  # bytes without a symbol are dropped
        if not known.all():
            symbols, owner = symbols[known], owner[known]
        done_symbols, done_owner = [], []
        rank, made = self._first_pairs(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            each = np.repeat(least, sizes)
            over = each == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                stay = ~over
                symbols, owner, rank, made, each = symbols[stay], owner[stay], rank[stay], made[stay], each[stay]
                if not len(symbols):
                    break
            at = self._apart(np.flatnonzero(rank == each), owner)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            moved = at - np.arange(len(at))  # only pairs with a merged symbol are new
            self._pairs(symbols, owner, rank, made, np.concatenate([moved, moved[moved > 0] - 1]))
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int32)
        of = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int32)
        ids = ids[np.argsort(of, kind="stable")]
        return ids.astype(np.uint32), np.append(0, np.cumsum(np.bincount(of, minlength=len(lengths))))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pair keys are merges, by binary search, and the merges' places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == key)
        return hit, place[hit]

    def _first_pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair of bytes that begins at each place."""
        rank, made = np.full(len(symbols), NO_RANK, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            at = self.place_of[symbols]
            same = owner[1:] == owner[:-1]
            rank[:-1] = np.where(same, self.base_rank[at[:-1], at[1:]], NO_RANK)
            made[:-1] = self.base_made[at[:-1], at[1:]]
        return rank, made

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        """Sets rank and result of the pairs that begin at the places `at`; NO_RANK where none does."""
        rank[at] = NO_RANK
        at = at[at + 1 < len(symbols)]
        at = at[owner[at + 1] == owner[at]]
        if len(at):
            hit, place = self.find(symbols[at].astype(self.key) << self.key(self.shift) | symbols[at + 1].astype(self.key))
            rank[at[hit]], made[at[hit]] = self.ranks[place], self.made[place]

    def _apart(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of places that overlap (a a a) every second one from the left; or the leftmost per word."""
        if not self.steady:
            return at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
        fresh = np.append(True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - run) % 2 == 0]


class WordEncoder:
    """Texts to ids for a vocabulary of lower-cased words whose white space is dropped.

    A text splits at white space into chunks; no token crosses one. A chunk's ids are kept
    when it comes a second time. After `most` chunks a new memory begins, which takes over what is used again
    from the one before; the one before that is forgotten.
    """

    def __init__(self, path: str, most: int = 400_000, decodes: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = MergeTable(spec)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(f"{split}|\n")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.most, self.decodes = most, decodes
        self.reset()

    def reset(self) -> None:
        """A new memory; the one until now becomes the old one."""
        self.old = (self.index, self.starts, self.sizes, self.pool) if hasattr(self, "index") else ({}, *[np.zeros(0, np.int64)] * 3)
        self.index: dict[str, int] = {}
        self.passing: dict[str, int] = {}
        self.doors = bytearray(1 << 22)
        self.decoded: list[str] = []
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        for text, i in self.table.special.items():  # a text's own chunks never begin with one "\0"
            self._add(["\0" + text], np.array([i], np.uint32), np.array([0, 1]))

    def _add(self, chunks: list[str], ids: np.ndarray, bounds: np.ndarray, kept: int | None = None) -> None:
        if self.decodes:
            name = self.table.strings
            tokens = [name[i] for i in ids.tolist()]
            self.decoded += [" ".join(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        kept = len(chunks) if kept is None else kept
        first = len(self.index)
        self.index.update(zip(chunks[:kept], range(first, first + kept), strict=True))
        self.passing = dict(zip(chunks[kept:], range(first + kept, first + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, bounds[:-1] + len(self.pool)])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
        self.pool = np.concatenate([self.pool, ids])

    def _simple(self, text: str) -> bool:
        """Below U+0300 composing changes nothing and lower case has no context."""
        return text.isascii() and not _CONTROL.search(text) or not _FAR.search(text)

    def chunks(self, text: str) -> list[str]:
        if self.specials is not None and "<" in text and (found := list(self.specials.finditer(text))):
            out, at = [], 0
            for m in found:
                out += self._plain(text[at : m.start()])
                out.append("\0" + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._simple(text):
            out = text.lower().split()
        else:
            out = [x for x in _SPACE.split(self.normalizer.normalize_str(text)) if x]
        return [x if x[0] != "\0" else "\0\0" + x for x in out] if "\0" in text else out

    def _pieces(self, chunks: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The chunks' words in a row, the words' lengths in bytes, and each chunk's first word (one entry more)."""
        joined = "\n".join(chunks)
        found = self.words.findall(joined)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        breaks = points[ends - 1] == 10 if len(found) else np.zeros(0, bool)  # no chunk has a line feed
        if len(found) and ends[-1] != len(joined):
            raise AssertionError("the words leave out characters")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        size = np.diff(np.append(0, np.cumsum(width)[ends - 1])) if len(found) else np.zeros(0, np.int64)
        firsts = np.concatenate([[0], np.cumsum(~breaks)[breaks], [int((~breaks).sum())]])
        return joined.replace("\n", "").encode("utf-8", "surrogatepass"), size[~breaks], firsts

    def _encode(self, chunks: list[str], kept: int) -> None:
        """Adds the ids of new chunks, in one batch of merge rounds; all but the first `kept` for this batch only."""
        far = [k for k, c in enumerate(chunks) if c[0] == "\0" or not c.isascii() and _BEYOND.search(c)]
        if not far:
            data, lengths, firsts = self._pieces(chunks)
            ids, starts = self.table.encode_flat(data, lengths)
        else:  # classes of newer characters as the library has them
            other = set(far)
            plain = [c for k, c in enumerate(chunks) if k not in other]
            data, lengths, bounds = self._pieces(plain) if plain else (b"", np.zeros(0, np.int64), np.zeros(1, np.int64))
            cuts, stops = np.append(0, np.cumsum(lengths)).tolist(), iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            words, firsts = [], [0]
            for k, c in enumerate(chunks):
                if k in other:
                    words += [bytes(self.bytes_of[x] for x in piece) for piece, _ in self.pre.pre_tokenize_str(c.removeprefix("\0\0"))]
                else:
                    first, stop = next(stops)
                    words += [data[cuts[w] : cuts[w + 1]] for w in range(first, stop)]
                firsts.append(len(words))
            ids, starts = self.table.encode(words)
        self._add(chunks, ids, starts[np.array(firsts)], kept)

    def _recall(self, chunks: list[str]) -> list[str]:
        """Takes over what the old memory knows of the chunks; the others."""
        before, starts, sizes, pool = self.old
        again = [c for c in chunks if c in before]
        if not again:
            return chunks
        at = np.fromiter(map(before.__getitem__, again), np.int64, len(again))
        ends = np.cumsum(sizes[at])
        self._add(again, pool[np.repeat(starts[at] - ends + sizes[at], sizes[at]) + np.arange(ends[-1])], np.append(0, ends))
        return [c for c in chunks if c not in before]

    def _forget_passing(self) -> None:
        """Drops what the last batch had for itself."""
        if self.passing:
            n = len(self.index)
            self.pool = self.pool[: self.starts[n]].copy()
            self.starts, self.sizes = self.starts[:n].copy(), self.sizes[:n].copy()
            del self.decoded[n:]
            self.passing = {}

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' chunks in a row, and where each text's begin (one entry more).

        They hold until the next call. Chunks seen once only are not kept.
        """
        self._forget_passing()
        lists = [self.chunks(t) for t in texts]
        flat = [c for own in lists for c in own]
        at = list(map(self.index.get, flat))
        missing = [i for i, x in enumerate(at) if x is None]
        if missing:
            fresh = Counter([flat[i] for i in missing])
            often = [c for c, n in fresh.items() if n > 1 or self._seen_before(c)]
            if len(self.index) + len(often) > self.most:
                self.reset()
                fresh = Counter(flat)
                missing, often = range(len(flat)), [c for c, n in fresh.items() if n > 1]
                often = [c for c in often if c not in self.index]
            often = self._recall(often)
            once = fresh.keys() - self.index.keys()
            once.difference_update(often)
            if often or once:
                self._encode([*often, *once], len(often))
            known, passing = self.index, self.passing
            for i in missing:
                c = flat[i]
                at[i] = known[c] if c in known else passing[c]
        return np.array(at, np.int64), np.append(0, np.cumsum(list(map(len, lists)))).astype(np.int64)

    def _seen_before(self, chunk: str) -> bool:
        """Whether a chunk (or one of the same hash) has come before; only decides what is kept."""
        slot = hash(chunk) & 0x3FFFFF
        found = self.doors[slot]
        self.doors[slot] = 1
        return bool(found)

    def gather(self, at: np.ndarray, bounds: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose chunks are known (then end, if given) in a row, and where each text's begin."""
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.pool[np.repeat(self.starts[at] - stops + sizes, sizes) + np.arange(total)]
        starts = np.append(0, stops)[bounds]
        if end is None:
            return ids, starts
        return np.insert(ids, starts[1:], np.uint32(end)), starts + np.arange(len(starts))

    def encode_batch(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one entry more than texts)."""
        return self.gather(*self.places(texts), end)

    def decode(self, at: np.ndarray) -> str:
        """What the library's decode gives for the ids of chunks: the tokens' strings with spaces between."""
        return " ".join(filter(None, map(self.decoded.__getitem__, at.tolist())))

    def decode_ids(self, ids) -> str:
        """The same from ids alone; ids outside the vocabulary are left out."""
        name = self.table.strings
        return " ".join(name[i] for i in ids if i in name)


_CONTROL = regex.compile(r"[\x1c-\x1f]")
_FAR = regex.compile(r"[\x1c-\x1f\u0300-\U0010ffff]")
_BEYOND = regex.compile(r"[\u0370-\U0010ffff]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(maxsize=2)
def word_encoder(path: str, decodes: bool = True) -> WordEncoder:
    """This worker's encoder, with what it has learnt from earlier tasks."""
    return WordEncoder(path, decodes=decodes)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids and the text decoded from them: doc_id, ids array<long>, decoded string.

    Null text counts as empty and has no ids; every row of the input gives one row, repeated
    ones too; null keys stay null; further columns are ignored.
    """

    def run(batch):
        encoder = word_encoder(path)
        ids, bounds = encoder.encode_batch(batch.column(1).to_pylist())
        decoded = [encoder.decode_ids(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64))), pa.array(decoded)], ["doc_id", "ids", "decoded"])

    return per_batch(doc_texts(docs, text, key), run, "doc_id long, ids array<long>, decoded string")


def encoding_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """encode_documents() as digests: doc_id, n_tokens, ids_sha256, decoded_sha256; same edge cases."""

    def run(batch):
        encoder = word_encoder(path)
        at, chunk_bounds = encoder.places(batch.column(1).to_pylist())
        ids, bounds = encoder.gather(at, chunk_bounds)
        raw = memoryview(ids.astype("<u4").tobytes())
        cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        sizes, ids_sha = [b - a for a, b in cut], [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in cut]
        text_sha = [hashlib.sha256(encoder.decode(at[a:b]).encode()).hexdigest() for a, b in zip(chunk_bounds[:-1], chunk_bounds[1:], strict=True)]
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(doc_texts(docs, text, key), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
