"""Token counts from finite-state transducers whose transitions carry emitted-token counts.

Two machines. The first splits a text into words: its transitions on character classes say
where words begin. The second reads a word's bytes; its transitions carry the change in the number
of tokens of what has been read, so that the sum along a word is its number of tokens. Its states are
made as texts need them.

Texts are cut into chunks. A chunk's state map says, for every state that it may be entered in: the
state it is left in, where its first and its last word begin, and the tokens of the words in between.
Neighbours' maps compose, whereby the word that lies across the border is counted; a parallel prefix
scan over the chunks of each text gives its number of tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from evenstep.llm.bpe import MergeTable, byte_characters
from evenstep.llm.common import doc_texts, per_batch

#: Character classes: end of a segment, letters apart from those of contractions, numbers, the
#: space, other white space, the apostrophe, the letters of contractions, all else.
CLASSES = ("end", "letter", "number", "space", "white", "quote", "s", "t", "m", "d", "r", "e", "v", "l", "other")
OF_CLASS = {c: i for i, c in enumerate(CLASSES)}
LETTERS = {"letter", "s", "t", "m", "d", "r", "e", "v", "l"}
#: What may follow a quote, and 'r, 'v and 'l: 's 't 'm 'd 're 've 'll.
SHORT, LONG = {"s", "t", "m", "d"}, {"r": "e", "v": "e", "l": "l"}
#: A transition's marks: a word begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2


def word_machine() -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and marks by (state, class), found from the start state on; and the start.

    A state is (kind of run, is it white and longer than one, was the last character a space).
    """

    def step(state: tuple, c: str) -> tuple[tuple, int]:
        kind, longer, spaced = state
        if kind in LONG:  # a quote and r, v or l stand behind
            if c == LONG[kind]:
                return ("start", False, False), 0
            following, marks = step(("letter", False, False), c)
            return following, marks | BEFORE
        if c == "end":
            return ("start", False, False), 0
        if c in ("space", "white"):
            joins = kind == "white"
            return ("white", joins, c == "space"), 0 if joins else HERE
        marks = HERE
        if kind == "white":
            marks = BEFORE * longer | HERE * (not spaced)
        attached = kind == "white" and spaced
        if c in LETTERS:
            if kind == "quote":
                if c in SHORT:
                    return ("start", False, False), 0
                if c in LONG:
                    return (c, False, False), 0
            return ("letter", False, False), 0 if kind == "letter" else marks
        if c == "number":
            return ("number", False, False), 0 if kind == "number" else marks
        if kind in ("other", "quote"):
            return ("other", False, False), 0
        return ("quote" if c == "quote" and not attached else "other", False, False), marks

    start = ("start", False, False)
    states, table, marks = {start: 0}, [], []
    for state in (queue := [start]):
        row = [step(state, c) for c in CLASSES]
        for following, _ in row:
            if following not in states:
                states[following] = len(states)
                queue.append(following)
        table.append([states[f] for f, _ in row])
        marks.append([m for _, m in row])
    return np.array(table, np.uint8), np.array(marks, np.uint8), 0


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OF_CLASS["other"], np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = OF_CLASS["letter"]
        elif kind == "N":
            out[c] = OF_CLASS["number"]
    for c in "\t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))):
        out[ord(c)] = OF_CLASS["white"]
    out[ord(" ")], out[ord("'")] = OF_CLASS["space"], OF_CLASS["quote"]
    for c in SHORT | {"r", "e", "v", "l"}:
        out[ord(c)] = OF_CLASS[c]
    return out


#: No place.
NONE = -2


class Maps:
    """State maps of chunks, by chunk and entry state: the state each is left in, the first and the last
    place where a word begins (NONE without one), and the tokens of words from the first to the last;
    `able` are the entry states that the character before a chunk can lead to."""

    __slots__ = ("able", "exits", "first", "last", "tokens")

    def __init__(self, able: np.ndarray, exits: np.ndarray, first: np.ndarray, last: np.ndarray, tokens: np.ndarray):
        self.able, self.exits, self.first, self.last, self.tokens = able, exits, first, last, tokens


class WordSplitter:
    """Runs the word machine over many chunks at a time."""

    def __init__(self, width: int = 256):
        self.table, self.marks, self.start = word_machine()
        self.states, self.classes = self.table.shape
        self.width = width
        #: by class: the states that reading it can lead to
        self.into = np.zeros((self.classes, self.states), bool)
        self.into[np.tile(np.arange(self.classes), self.states), self.table.ravel()] = True

    def run(self, chunks: np.ndarray, before: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks as rows of classes, and the class before each: which entry states are possible, the exit
        states, places of begins that don't hang on the entry state (a row for each place from -1
        on), and (chunk, entry state, place) of those that do, in ascending order.

        All possible entry states run side by side until they meet; then the chunk goes on alone.
        """
        n, width = chunks.shape
        flat, marks = self.table.ravel(), self.marks.ravel()
        able = self.into[before]
        row, entry = np.nonzero(able)
        state, exits = entry.astype(np.uint8), np.zeros((n, self.states), np.uint8)
        common, found = np.zeros((width + 1, n), bool), [np.zeros((3, 0), np.int64)]
        alone, lone = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for k, column in enumerate(np.ascontiguousarray(chunks.T)):
            if k % step == 0 and len(row):  # those whose states have met
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                met = np.minimum.reduceat(state, starts) == np.maximum.reduceat(state, starts)
                alone, lone = np.append(alone, row[starts[met]]), np.append(lone, state[starts[met]])
                apart = ~np.repeat(met, np.diff(np.append(starts, len(row))))
                row, entry, state = row[apart], entry[apart], state[apart]
            if len(alone):
                at = lone.astype(np.int64) * self.classes + column[alone]
                m, lone = marks[at], flat[at]
                common[k + 1, alone] |= (m & HERE).astype(bool)
                common[k, alone] |= (m & BEFORE).astype(bool)
            if len(row):
                at = state.astype(np.int64) * self.classes + column[row]
                m, state = marks[at], flat[at]
                for mark, place in ((BEFORE, k - 1), (HERE, k)):
                    hit = np.flatnonzero(m & mark)
                    found.append(np.stack([row[hit], entry[hit], np.full(len(hit), place)]))
        exits[alone] = lone[:, None]
        exits[row, entry] = state
        own = np.concatenate(found, 1)
        return able, exits, common, tuple(own[:, np.lexsort((own[2], own[1], own[0]))])

    def entries(self, exits: np.ndarray) -> np.ndarray:
        """Every chunk's entry state: exit maps of all prefixes, by doubling; after round r each holds 2**r chunks."""
        exits, reach = exits.copy(), 1
        while reach < len(exits):
            exits[reach:] = np.take_along_axis(exits[reach:], exits[:-reach].astype(np.int64), 1)
            reach *= 2
        return np.append(np.uint8(self.start), exits[:-1, self.start])

    def begins(self, classes: np.ndarray) -> np.ndarray:
        """Places where words begin in one text's classes."""
        n = len(classes)
        padded = np.full(-(-max(n, 1) // self.width) * self.width, OF_CLASS["end"], np.uint8)
        padded[:n] = classes
        chunks = padded.reshape(-1, self.width)
        able, exits, common, (row, entry, place) = self.run(chunks, np.append(OF_CLASS["end"], chunks[:-1, -1]))
        right = self.entries(exits)[row] == entry
        where, column = np.nonzero(common.T)
        return np.sort(np.append(where * self.width + column - 1, row[right] * self.width + place[right]))

    def maps(self, chunks: np.ndarray, before: np.ndarray, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Maps:
        """The chunks' maps. count gives the tokens of the words from places to places. The first `end` after
        a text's last character also is a place, so that it closes the last word."""
        able, exits, common, (row, entry, place) = self.run(chunks, before)
        n, width = chunks.shape
        end = chunks == OF_CLASS["end"]
        common[1:] |= (end & ~np.concatenate([(before == OF_CLASS["end"])[:, None], end[:, :-1]], 1)).T
        at, column = np.nonzero(common.T)
        common_place, place = at * width + column - 1, row * width + place
        first, last, tokens = np.full(n, NONE), np.full(n, NONE), np.zeros(n, np.int64)
        last[at] = common_place  # the last one assigned stays
        first[at[::-1]] = common_place[::-1]
        same = np.flatnonzero(at[1:] == at[:-1])
        # words between places of one entry state, and from its last place to the first common one
        key = row * self.states + entry
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        inner = np.flatnonzero(key[1:] == key[:-1])
        tails = np.append(heads[1:], len(key))[: len(heads)] - 1
        of = row[heads]
        into = np.flatnonzero(first[of] != NONE)
        counts = count(np.concatenate([common_place[same], place[inner], place[tails][into]]), np.concatenate([common_place[same + 1], place[inner + 1], first[of][into]]))
        tokens += np.bincount(at[same], counts[: len(same)], n).astype(np.int64)
        spread = lambda x: np.repeat(x[:, None], self.states, 1)
        out = Maps(able, exits, spread(first), spread(last), spread(tokens))
        more = np.bincount(key[inner], counts[len(same) : len(same) + len(inner)], n * self.states) + np.bincount(key[heads][into], counts[len(same) + len(inner) :], n * self.states)
        out.tokens += more.astype(np.int64).reshape(n, self.states)
        out.first[of, entry[heads]] = place[heads]
        out.last[of, entry[heads]] = np.where(last[of] == NONE, place[tails], last[of])
        return out

    def scan(self, maps: Maps, depth: np.ndarray, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Maps:
        """Maps of all prefixes of each text's chunks (depth: a chunk's number in its text), by doubling."""
        able, exits, first, last, tokens = (x.copy() for x in (maps.able, maps.exits, maps.first, maps.last, maps.tokens))
        reach = 1
        while (right := np.flatnonzero(depth >= reach)).size:
            k, s = np.nonzero(able[right - reach])
            b, a = right[k], right[k] - reach
            t = exits[a, s]  # left in t, the right one is entered in it
            across = np.flatnonzero((last[a, s] != NONE) & (first[b, t] != NONE))
            joint = np.zeros(len(a), np.int64)
            joint[across] = count(last[a, s][across], first[b, t][across])
            made = (
                np.where(first[a, s] == NONE, first[b, t], first[a, s]), np.where(last[b, t] == NONE, last[a, s], last[b, t]),
                tokens[a, s] + joint + tokens[b, t], exits[b, t],
            )
            able[right] = able[right - reach]
            for x, new in zip((first, last, tokens, exits), made, strict=True):
                x[b, s] = new
            reach *= 2
        return Maps(able, exits, first, last, tokens)


class CountMachine:
    """The transducer over a word's bytes. A state holds, for each place of the word that a
    longer token may still begin at: the node of the vocabulary's trie that has been reached
    from there, the last token of what stands before the place, and by how many tokens that part
    has fewer than the whole. Byte-pair encoding of a prefix is the encoding of a shorter prefix
    and one more token, the only one that goes with that prefix's last token.
    """

    def __init__(self, table: MergeTable, of: dict[str, int], most: int = 350_000):
        if not table.steady:
            raise ValueError("merges must not make pairs of lower rank")
        self.pair = {(a, b): (r, c) for r, (a, b, c) in enumerate(table.pairs)}
        made = {c: (r, a, b) for r, (a, b, c) in enumerate(table.pairs)}
        self.left, self.right = {}, {}
        for i in table.vocab.values():
            self.left[i], self.right[i] = self._spine(made, i, 1), self._spine(made, i, 2)
        self.trie: list[dict[int, int]] = [{}]
        self.token = [-1]
        reachable = {int(i) for i in table.inner} | set(made)
        for s, i in table.vocab.items():
            if i in reachable:
                node = 0
                for c in s:
                    following = self.trie[node].get(of[c])
                    if following is None:
                        following = self.trie[node][of[c]] = len(self.trie)
                        self.trie.append({})
                        self.token.append(-1)
                    node = following
                self.token[node] = i
        self.most = most
        self.fits_memory: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def _spine(self, made: dict, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost parts of a token, smallest first, each with the rank of the merge that uses it up."""
        out, used = [], 1 << 60
        while True:
            out.append((token, used))
            if token not in made:
                return out[::-1]
            used, token = made[token][0], made[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode as a, b: no merge across comes first."""
        found = self.fits_memory.get((a, b))
        if found is None:
            if len(self.fits_memory) > self.most:
                self.fits_memory.clear()
            found = True
            for x, x_used in self.right[a]:
                for y, y_used in self.left[b]:
                    across = self.pair.get((x, y))
                    if across is not None and across[0] < x_used and across[0] <= y_used:
                        found = False
            self.fits_memory[a, b] = found
        return found

    def _grow(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's next state and count, made when first needed."""
        live, token, emitted = [], None, 0
        for node, last, less in self.states[state]:
            following = self.trie[node].get(byte)
            if following is None:
                continue
            t = self.token[following]
            if token is None and t >= 0 and (last < 0 or self.fits(last, t)):
                token, emitted = t, less + 1
            if self.trie[following]:
                live.append((following, last, less))
        key = (*((node, last, less - emitted) for node, last, less in live), (0, token, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], emitted

    def count(self, word: bytes) -> int:
        if len(self.next) > self.most:
            self.reset()
        state = total = 0
        known = self.next
        for byte in word:
            key = state << 8 | byte
            found = known.get(key)
            if found is None:
                found = known[key] = self._grow(state, byte)
            state = found[0]
            total += found[1]
        return total


class TokenCounter:
    """Counts tokens of texts for a byte-level tokenizer file; words are remembered up to `most`."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level files without a normalizer or prefix space are supported")
        self.table = MergeTable(spec)
        self.machine = CountMachine(self.table, {c: b for b, c in enumerate(byte_characters())})
        self.splitter = WordSplitter()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None
        self.most = most
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        segments, owners, extra = [], [], [0] * len(texts)
        for d, t in enumerate(texts):
            parts = self.specials.split(t) if self.specials is not None and "<|" in t else [t]
            extra[d] = len(parts) - 1
            segments += parts
            owners += [d] * len(parts)
        width = self.splitter.width
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chunks = sizes // width + 1  # at least one character is left for the end
        joined = "".join([s + "\0" * n for s, n in zip(segments, (chunks * width - sizes).tolist(), strict=True)])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(chunks)
        inside = np.arange(len(points)) < np.repeat((stops - chunks) * width + sizes, chunks * width)
        classes = np.where(inside, class_table()[points], np.uint8(OF_CLASS["end"]))
        depth = np.arange(int(stops[-1])) - np.repeat(stops - chunks, chunks) if len(stops) else np.zeros(0, np.int64)
        rows = classes.reshape(-1, width)
        before = np.where(depth == 0, OF_CLASS["end"], np.append(0, rows[:-1, -1])[: len(rows)])

        def count(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.zeros(len(starts), np.int64)
            true = np.flatnonzero(inside[starts] & (starts >= 0))  # no word begins at an end
            words = [joined[a:b] for a, b in zip(starts[true].tolist(), ends[true].tolist(), strict=True)]
            out[true] = self._tokens(words)
            return out

        maps = self.splitter.scan(self.splitter.maps(rows, before, count), depth, count)
        totals = maps.tokens[stops - 1, self.splitter.start]
        return (np.bincount(owners, totals, len(texts)).astype(np.int64) + extra).tolist()

    def _tokens(self, words: list[str]) -> np.ndarray:
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = set(words)
        count = self.machine.count
        self.known.update((w, count(w.encode("utf-8", "surrogatepass"))) for w in sorted(fresh))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """This worker's counter, with the states that earlier tasks made."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    Null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token.
    Null keys stay null, repeated rows each give a row, further columns are ignored, an empty
    table gives no rows. A text is counted whole, however long.
    """

    def run(batch):
        texts = batch.column(1)
        tokens = token_counter(path).counts(texts.to_pylist())
        return pa.record_batch([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return per_batch(doc_texts(docs, text, key), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
