"""Vector bin packing of tokenised documents into training sequences.

Every example is a vector (tokens, segments, loss-bearing tokens), every sequence a bin with a
limit in each dimension. The dot-product heuristic puts into the open bin, again and again, the
example that fits and whose vector has the largest product with the bin's remaining room.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from evenstep.llm.bpe import byte_characters
from evenstep.llm.common import doc_texts, small_batches

END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """Text to ids as the byte-level tokenizer file gives them, special strings included."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    import public_tokenizers

    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cache
    def exact() -> Tokenizer:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        return library

    def ids(text: str) -> np.ndarray:
        # newer characters' classes and endless runs of one kind are left to the library itself
        if len(text) > 1 << 17 or not text.isascii() and max(text) >= "\u0370":
            return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)
        if "<|" in text:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id's text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    sizes = {i: len(s) for s, i in spec["model"]["vocab"].items()} | {i: len(s.encode()) for s, i in special.items()}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def leading_tokens(ids: np.ndarray, sizes: np.ndarray, n_bytes: int) -> int:
    """How many of the first ids lie wholly in the first n_bytes bytes."""
    return int(np.searchsorted(np.cumsum(sizes[ids[:n_bytes]]), n_bytes, "right")) if n_bytes else 0


def dot_product_packing(items: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers; items: (n, d) non-negative, each within the limits alone.

    Equal vectors are one kind with a count; kinds stand in order, so results do not hang on
    the order of equal items. Bins open one at a time with the largest item that is left.
    """
    if not len(items):
        return []
    kinds, kind_of = np.unique(items, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    counts = np.bincount(kind_of.ravel(), minlength=len(kinds))
    firsts = np.append(0, np.cumsum(counts))[:-1]
    taken = np.zeros(len(kinds), np.int64)
    share = kinds / limits
    weight = share.sum(0) / max(share.sum(), 1e-12)  # scarce dimensions count more
    scaled = share * weight
    size = scaled.sum(1)
    bins, left = [], int(counts.sum())
    alive = np.arange(len(kinds))
    while left:
        room, own = limits.astype(np.int64).copy(), []
        alive = alive[counts[alive] > taken[alive]]
        k = int(alive[np.argmax(size[alive])])
        while True:
            own.append(int(order[firsts[k] + taken[k]]))
            taken[k] += 1
            left -= 1
            room -= kinds[k]
            fits = alive[(counts[alive] > taken[alive]) & (kinds[alive] <= room).all(1)]
            if not len(fits):
                break
            k = int(fits[np.argmax(scaled[fits] @ (room / limits))])
        bins.append(own)
    return bins


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def first_line(text: str) -> int:
    """Characters of a text's prompt by a plain rule: its first line with the break; none if it is all there is."""
    return text.find("\n") + 1


def pack_lengths(lengths: np.ndarray, most: int = 2048, segments: int = 256, loss: int = 2048, lossless: int = 0, least_tail: int = 64, prompts: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of the given token counts.

    Documents longer than a sequence are cut into pieces that are as long as the limits let them
    be; pieces are packed by vectors. Afterwards the emptiest sequences are dissolved: their
    pieces, cut as needed, fill the gaps of the others, within the limits. A sequence that still
    has a gap is cut into powers of two (which need no padding) down to least_tail.
    loss: limit of loss-bearing tokens; tokens without loss are a document's first `prompts`
    ones and the first `lossless` of each piece.
    """
    until = [0] * len(lengths) if prompts is None else np.minimum(prompts, lengths).tolist()
    bears = lambda d, at, n: max(at + n - max(at + lossless, until[d]), 0)
    within = lambda d, at, room: room + max(lossless, until[d] - at)  # noqa: E731  (the longest piece for this room)
    done: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        at = 0
        while at < n:
            size = min(n - at, most, within(d, at, loss))
            (done.append([(d, at, size)]) if size == most else rest.append((d, at, size)))
            at += size
    vectors = np.array([(n, 1, bears(d, at, n)) for d, at, n in rest], np.int64).reshape(-1, 3)
    bins = [[rest[i] for i in own] for own in dot_product_packing(vectors, np.array([most, segments, loss]))]
    fill = lambda own: sum(n for _, _, n in own)
    bins.sort(key=lambda own: (-fill(own), own))
    gaps = [i for i, own in enumerate(bins) if fill(own) < most]
    low, high = 0, len(gaps) - 1
    while low < high:  # the emptiest bin feeds the fullest that has a gap
        to, source = bins[gaps[low]], bins[gaps[high]]
        gap, room = most - fill(to), loss - sum(bears(*p) for p in to)
        # the piece of which most fits, the last of equal ones
        take, k = max((min(n, gap, within(d, at, room)), k) for k, (d, at, n) in enumerate(source))
        if take <= 0 or len(to) >= segments:
            low += 1
            continue
        d, at, n = source.pop(k)
        to.append((d, at, take))
        if n > take:
            source.insert(k, (d, at + take, n - take))
        if not source:
            high -= 1
    out = done
    for own in filter(None, bins):
        total = fill(own)
        if total == most or total & (total - 1) == 0:
            out.append(own)
            continue
        for size in powers(total) if most - total >= least_tail else [total]:
            part, need = [], size
            while need and own:
                d, at, n = own.pop(0)
                take = min(n, need)
                part.append((d, at, take))
                if n > take:
                    own.insert(0, (d, at + take, n - take))
                need -= take
            out.append(part)
    return out


def pack_documents(
    docs: DataFrame, path: str, most: int = 2048, segments: int = 256, loss: int | None = None, lossless: int = 0, window_tokens: int = 1 << 20, text: str = "text", key: str = "doc_id",
    prompt: Callable[[str], int] | None = None, ids_of: Callable[[str], Callable[[str], np.ndarray]] = byte_encoder,
) -> DataFrame:
    """Packs every document's ids, then END_ID, into sequences: one row per piece (PIECES).

    A sequence has at most `most` tokens, `segments` pieces and `loss` tokens that bear loss. prompt
    says how many of a text's first characters are a prompt, whose tokens bear none.

    No shuffle: each task packs windows of window_tokens ids (4 MB) of its own rows, so the
    memory does not grow with the input. sequence_id is the task's number and a count, unique
    but with gaps. Null text is empty and has one token; null keys stay null; repeated rows are
    packed each; further columns are ignored; an empty table gives no rows. The input should
    be a scan of files: a task that runs again must see its rows in the same order.
    """
    loss = most if loss is None else loss

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 40
        encode = ids_of(path)
        sizes = token_bytes(path) if prompt else None
        names, held, prompts, tokens = [], [], [], 0

        def flush():
            nonlocal number
            columns = [[] for _ in range(8)]
            for sequence in pack_lengths(np.array([len(x) for x in held], np.int64), most, segments, loss, lossless, prompts=np.array(prompts, np.int64)):
                offset = 0
                for d, at, n in sequence:
                    crc = zlib.crc32(held[d][at : at + n].astype("<u4").tobytes())
                    for column, value in zip(columns, (names[d], at, n, crc, len(held[d]), number, offset, max(at + n - max(at + lossless, prompts[d]), 0)), strict=True):
                        column.append(value)
                    offset += n
                number += 1
            names.clear(), held.clear(), prompts.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

        for batch in small_batches(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t), np.uint32(END_ID))
                names.append(name)
                held.append(ids)
                prompts.append(leading_tokens(ids[:-1], sizes, len(t[: prompt(t)].encode())) if prompt else 0)
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return doc_texts(docs, text, key).mapInArrow(run, PIECES)
