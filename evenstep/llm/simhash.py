"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most r of 64 bits agree in at least two of r + 2 parts, so each
fingerprint stands in one bucket for every pair of parts. A bucket's fingerprints are compared
with bit planes: plane b holds bit b of 64 fingerprints in a word. Carry-save counters add up
differing planes for 64 distances in each operation, and a block of words is abandoned once all
its distances exceed the radius.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import doc_texts, per_batch, written
from evenstep.llm.components import Forest, connected_components

RADIUS = 3
WIDTH = 3
SEED = 42
#: Members of a bucket that one task compares at a time; larger buckets go to more tasks.
TILE = 4096


def shingle_hashes(text: str, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `width` words of the text in lower case, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return [h(line, seed)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = np.append(0, ends[: -width] + 1)
    return [h(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(lists: list[list[int]]) -> np.ndarray:
    """A bit of a document's fingerprint is 1 if over half of its hashes have it; none: 0."""
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
    starts = np.append(0, np.cumsum(sizes[full]))[:-1]
    ones = np.empty((len(full), 64), np.int64)
    bits = flat.astype(">u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):  # a byte at a time keeps the unpacked bits small
        ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(bits[:, byte : byte + 1], axis=1), starts, axis=0, dtype=np.int32)
    high = (2 * ones > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(high, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit planes of fingerprints; word w of plane b has bit b of 64 fingerprints."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)


def near(queries: np.ndarray, stored: np.ndarray, radius: int = RADIUS, block: int = 8) -> np.ndarray:
    """Pairs (query, member of the planes `stored`) that differ in at most radius bits.

    Counters are kept as planes of digits, saturating above the radius; a row of `block`
    words whose distances are all above it leaves the comparison.
    """
    words = stored.shape[1]
    blocks = -(-words // block)
    if words % block:
        stored = np.pad(stored, ((0, 0), (0, blocks * block - words)))
    cut = stored.reshape(64, blocks, block)
    digits = max(int(radius).bit_length(), 1)
    q, w = np.repeat(np.arange(len(queries)), blocks), np.tile(np.arange(blocks), len(queries))
    counters = [np.zeros((len(q), block), np.uint64) for _ in range(digits)]
    over = np.zeros((len(q), block), np.uint64)
    for b in range(64):
        flip = (np.uint64(0) - ((queries[q] >> np.uint64(63 - b)) & np.uint64(1)))[:, None]
        carry = cut[b, w] ^ flip
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if b % 8 == 7 and b < 63:
            live = (over != _ALL).any(1)
            if not live.all():
                q, w, over = q[live], w[live], over[live]
                counters = [c[live] for c in counters]
                if not len(q):
                    return np.zeros((0, 2), np.int64)
    for bit in range(1 << digits):  # counts above the radius that fit the digits
        if bit > radius:
            match = np.full(over.shape, _ALL)
            for d in range(digits):
                match &= counters[d] if bit >> d & 1 else ~counters[d]
            over |= match
    hits = np.unpackbits((~over).view(np.uint8), axis=1)
    row, at = np.nonzero(hits)
    return np.stack([q[row], w[row] * block * 64 + at], 1)


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def near_pairs(values: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS, most_words: int = 1 << 16) -> np.ndarray:
    """Pairs of numbers (i, j) of near members of values and other; of values alone with i < j."""
    against = values if other is None else other
    stored = planes(against)
    step = max(1, most_words // stored.shape[1])
    found = []
    for k in range(0, len(values), step):
        pairs = near(values[k : k + step], stored, radius)
        pairs[:, 0] += k
        pairs = pairs[pairs[:, 1] < len(against)]
        found.append(pairs if other is not None else pairs[pairs[:, 0] < pairs[:, 1]])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def small_buckets(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS, most: int = 64) -> np.ndarray:
    """Near pairs within runs of equal keys of at most `most` members, for all runs at a time:
    each member is compared with the d-th after it, d = 1, 2, ..., by planes of the differences."""
    found, d = [], 1
    while d < most:
        at = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(at):
            break
        # planes of differences: a query of zero against them gives the pairs' distances
        hit = near(np.zeros(1, np.uint64), planes(values[at] ^ values[at + d]), radius)[:, 1]
        hit = at[hit[hit < len(at)]]
        found.append(np.stack([hit, hit + d], 1))
        d += 1
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def masks(radius: int = RADIUS) -> list[int]:
    """For every pair of radius + 2 parts of 64 bits, the bits of both."""
    bounds = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [x | y for x, y in combinations(parts, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, long) that join all near ones.

    Not all near pairs: of a bucket only as many as join what is near in it. A bucket of over
    `tile` members is cut into tiles, and each pair of tiles is compared by a task of its own.
    """
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)))).alias("part", "key"))
    keyed = keyed.select("part", "key", "fp")
    hot = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    hot = written(hot.select("part", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "hot-buckets")
    if hot.isEmpty():
        return _bucket_edges(keyed, radius)
    edges = _bucket_edges(keyed.join(hot, ["part", "key"], "left_anti"), radius)
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = keyed.join(hot, ["part", "key"]).withColumn("own", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("own", t).alias("x"), F.greatest("own", t).alias("y")))
    dealt = dealt.select("part", "key", "own", "fp", F.explode(pair).alias("pair")).select("part", "key", "own", "fp", "pair.x", "pair.y")
    return edges.unionByName(_tile_edges(dealt, radius))


def _edges_batch(forest: Forest) -> pa.RecordBatch:
    stars = forest.stars()
    return pa.record_batch([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], ["a", "b"])


def _runs(batches, columns: int, least: int = 1 << 16):
    """Arrays of sorted rows in pieces that don't cut a run of equal leading columns."""
    held = None
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        held = new if held is None else np.concatenate([held, new], 1)
        if held.shape[1] < least:
            continue
        change = np.flatnonzero((held[:columns, 1:] != held[:columns, :-1]).any(0))
        if len(change):
            yield held[:, : change[-1] + 1]
            held = held[:, change[-1] + 1 :]
    if held is not None and held.shape[1]:
        yield held


def _bucket_edges(keyed: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for part, key, fp in _runs(batches, 2):
            values, forest = fp.astype(np.uint64, casting="unsafe"), Forest()
            fresh = np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, len(fp)))
            run_of = np.cumsum(fresh)
            small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
            picked = np.flatnonzero(small)
            pairs = [picked[small_buckets(run_of[picked], values[picked], radius)]]
            for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
                pairs.append(near_pairs(values[s : s + n], None, radius) + s)
            for p in pairs:
                for a, b in zip(fp[p[:, 0]].tolist(), fp[p[:, 1]].tolist(), strict=True):
                    forest.join(a, b)
            if forest.up:
                yield _edges_batch(forest)

    return keyed.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long")


def _tile_edges(dealt: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for part, key, x, y, own, fp in _runs(batches, 4, 1):
            fresh = np.append(True, ((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            bounds = [*np.flatnonzero(fresh).tolist(), len(fp)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                forest, values, mine = Forest(), fp[s:e].astype(np.uint64, casting="unsafe"), own[s:e] == x[s]
                if x[s] == y[s]:
                    left = right = np.arange(e - s)
                    pairs = near_pairs(values, None, radius)
                else:
                    left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
                    if not len(left) or not len(right):
                        continue
                    pairs = near_pairs(values[left], values[right], radius)
                for a, b in zip(fp[s + left[pairs[:, 0]]].tolist(), fp[s + right[pairs[:, 1]]].tolist(), strict=True):
                    forest.join(a, b)
                if forest.up:
                    yield _edges_batch(forest)

    order = ["part", "key", "x", "y"]
    return dealt.select(*order, "own", "fp").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def fingerprint_documents(docs: DataFrame, width: int = WIDTH, seed: int = SEED, text: str = "text", key: str = "doc_id", with_hash: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row; null and empty texts have 0.
    On request also text_sha256, which tells rows of one doc_id apart."""

    def run(batch):
        texts = batch.column(1).to_pylist()
        prints = fingerprints([shingle_hashes(t, width, seed) for t in texts])
        columns = {"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))}
        if with_hash:
            columns["text_sha256"] = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())
        return pa.record_batch(list(columns.values()), list(columns))

    return per_batch(doc_texts(docs, text, key), run, f"doc_id long, fp long{', text_sha256 string' if with_hash else ''}")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, seed: int = SEED, tile: int = TILE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest key that fingerprints reach over steps of at most radius bits.
    Null text counts as empty; texts without words have fingerprint zero and link like any
    other; null keys are kept and never are the smallest, unless alone; repeated rows share
    their component; further columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprint_documents(docs, width, seed, text, key), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = connected_components(links(distinct, radius, tile))
    # each side of a join on a key with many rows is a table, so that Spark can split the key
    joined = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked-prints")
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    linked = joined.join(least, "root").select("fp", "component_id")
    of = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, seed: int = SEED, tile: int = TILE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text_sha256 of one row for every component of near_duplicates().

    It is the row with the smallest key (a null key only if all are null), of rows with that key
    the one with the smallest hash. So each component has its own row, however often a key is
    null or stands in the table. Edge cases are those of near_duplicates().
    """
    prints = written(fingerprint_documents(docs, width, seed, text, key, with_hash=True), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("least")
    distinct = written(prints.groupBy("fp").agg(least), "distinct-prints")
    roots = connected_components(links(distinct, radius, tile))
    joined = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least"), "linked-prints")
    return joined.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.text_sha256")
