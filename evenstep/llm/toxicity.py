"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; tokens get labels from them: a token is a mark if its word or a beginning
of it stands, once or several times, in toxic documents beyond doubt; marks are toxic in toxic
documents and plain in others, where they stand by chance or in passing. The field learns from
these tokens, and forward-backward marginals give each token's probability. The tagged tokens'
sum, the expected number of toxic ones, and its share of the text give a document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import doc_texts, per_batch, small_batches, written
from evenstep.llm.witnesses import copy_groups, least_hashes

THRESHOLD = 0.7
#: Bounds of the labelled sample that the field is fitted on: rows of either label, and bytes of a row.
TOXIC_ROWS, CLEAN_ROWS, ROW_BYTES = 1500, 3500, 100_000
#: Lengths of the beginnings of words that are features beside the words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: How often a feature must stand in a document to be counted there; each is a test of its own.
TIMES = (1, 2, 3)
#: The least share of toxic ones among the documents that a mark stands in.
LEAST_SHARE = 0.7
#: Rows of a group of near copies that one task counts; larger groups are counted in parts.
GROUP_ROWS = 64
#: Plain tokens that a mark is learnt with on either side, and the longest piece of a text to learn from at a time.
AROUND, SPAN = 6, 32
#: The marginal that tags a token.
TAGGED = 0.5
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def token_features(word: str) -> list[str]:
    """Names of a token's features: its beginnings, shortest first, and its word, in lower case."""
    word = word.lower()
    return [*(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n), f"w:{word}"]


def beyond_doubt(k: Column, n: Column, base: float, tests: int) -> Column:
    """Whether k toxic of n documents can't be chance at this base rate, by Chernoff's bound over all tests."""
    share = k / F.greatest(n, F.lit(1))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    apart = F.when(share > 0, share * F.log(share / base)).otherwise(0.0) + rest
    return (k >= 3) & (share >= max(LEAST_SHARE, base)) & (share > base) & (n * apart > log(tests / 0.01))


class Field:
    """Two labels; emission weights of features and a bias for label 1; transition weights. The
    verdict on a document: weights of a constant, of the logarithm of its expected number of
    toxic tokens and of that of their number in a thousand."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -8.0, moves: np.ndarray | None = None, verdict: tuple[float, float, float] = (0.0, 1.0, 0.0)):
        self.weights = weights or {}
        self.bias = bias
        self.moves = np.zeros((2, 2)) if moves is None else moves
        self.verdict = verdict
        #: the first letters that tokens with known features can have
        self.heads = frozenset(f.partition(":")[2][: PREFIXES[0]] for f in self.weights)
        self.memory: dict[str, float | None] = {}

    def emission(self, token: str) -> float | None:
        """What a token adds to the bias; None if it has no known feature."""
        known = [self.weights[f] for f in token_features(token) if f in self.weights]
        return sum(known) if known else None

    def marginals(self, places: list[int], adds: list[float], n: int) -> np.ndarray:
        """Probabilities of label 1 at the places of n tokens; all other tokens have only the bias.

        Exact forward and backward messages over the whole text: a run of plain tokens is a
        power of one matrix.
        """
        potentials = np.exp(np.stack([np.zeros(len(adds)), np.clip(self.bias + np.array(adds), -40, 40)], 1))
        move, plain = np.exp(self.moves), np.exp([0.0, self.bias])
        step = move * plain  # from a label over one plain token
        forward, message, at = [], plain / plain.sum(), 1  # the first token has no label before it
        for p, e in zip(places, potentials, strict=True):
            message = self._over(message, step, p - at) if p > at else message
            message = message @ move * e if p else e
            message = message / message.sum()
            forward.append(message)
            at = p + 1
        message, at = np.ones(2), n
        out = np.empty(len(places))
        for i in range(len(places) - 1, -1, -1):
            gap = at - places[i] - 1
            message = self._over(message, step.T, gap) if gap else message
            both = forward[i] * message
            out[i] = both[1] / both.sum()
            message = move @ (potentials[i] * message)
            message /= message.sum()
            at = places[i]
        return out

    @staticmethod
    def _over(message: np.ndarray, step: np.ndarray, n: int) -> np.ndarray:
        power = step
        while n:
            if n & 1:
                message = message @ power
                message = message / message.sum()
            power = power @ power
            power = power / power.max()
            n >>= 1
        return message

    def evidence(self, text: str) -> tuple[int, list[int], np.ndarray]:
        """Number of tokens, places of those with known features, and their marginals."""
        tokens, n, memory, heads = _TOKEN.findall(text), PREFIXES[0], self.memory, self.heads
        places, adds = [], []
        for i in [i for i, t in enumerate(tokens) if t.lower()[:n] in heads]:
            t = tokens[i]
            if t not in memory:
                if len(memory) >= 20_000:
                    memory.clear()
                memory[t] = self.emission(t)
            if memory[t] is not None:
                places.append(i)
                adds.append(memory[t])
        return len(tokens), places, self.marginals(places, adds, len(tokens)) if places else np.zeros(0)

    def score(self, text: str) -> float:
        """The document's probability from its tagged tokens (marginal of 0.5 or more); without
        one the largest marginal, 0 where no token has a known feature."""
        n, _, p = self.evidence(text)
        return self._verdict(n, p)

    def _verdict(self, n: int, p: np.ndarray) -> float:
        tagged = p[p >= TAGGED]
        if not len(tagged):
            return float(p.max(initial=0.0))
        z = float(np.dot(self.verdict, totals(n, float(tagged.sum()))))
        return 1 / (1 + exp(-max(min(z, 40.0), -40.0)))

    def judged(self, text: str, least: float = TAGGED) -> tuple[float, list[tuple[int, int, float]]]:
        """score() and spans(): (start, end, probability) of the toxic tokens, by character."""
        n, places, p = self.evidence(text)
        if not places:
            return 0.0, []
        toxic = {i: float(x) for i, x in zip(places, p, strict=True) if x >= least}
        found = [(m.start(), m.end(), toxic[i]) for i, m in enumerate(_TOKEN.finditer(text)) if i in toxic] if toxic else []
        return self._verdict(n, p), found

    def spans(self, text: str, least: float = TAGGED) -> list[tuple[int, int, float]]:
        return self.judged(text, least)[1]


def totals(n: int, expected: float) -> tuple[float, float, float]:
    """What a verdict weighs."""
    return 1.0, log1p(expected), log1p(1000 * expected / max(n, 1))


def feature_counts(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """feature, and c0, c1, ...: the toxic groups, then the clean ones, that have it at least TIMES times,
    of rows (grp, toxic, text). A group's copies count as one with the largest number of each.

    A task has whole groups and adds up what it sees; what it holds is passed on at `most` features. Of
    groups in several parts (column part, null for others) a task has a part, and passes on how often it
    has each feature; the largest of a group's parts counts.
    """
    width = len(TIMES)
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(None).cast("int"))

    def run(batches):
        found: dict[str, int] = {}  # all counts of a feature in one number, 16 bits each
        open_key, held, groups = None, Counter(), 0

        def of_part():
            grp, toxic, _ = open_key
            columns = [pa.array(list(held), pa.string()), pa.array([grp] * len(held), pa.int32()), pa.array([toxic] * len(held), pa.int32()), pa.array(list(held.values()), pa.int64())]
            out = pa.record_batch([*columns, *[pa.nulls(len(held), pa.int64())] * (2 * width)], names)
            held.clear()
            return out

        def close():
            shift = 0 if open_key[1] else 16 * width
            ones = [sum(1 << (16 * j + shift) for j, times in enumerate(TIMES) if n >= times) for n in range(max(TIMES) + 1)]
            for f, n in held.items():
                found[f] = found.get(f, 0) + ones[min(n, len(ones) - 1)]
            held.clear()

        def passed():
            counts = [pa.array([v >> 16 * j & 0xFFFF for v in found.values()], pa.int64()) for j in range(2 * width)]
            empty = [pa.nulls(len(found), k) for k in (pa.int32(), pa.int32(), pa.int64())]
            out = pa.record_batch([pa.array(list(found), pa.string()), *empty, *counts], names)
            found.clear()
            return out

        for batch in small_batches(batches):
            *key_columns, texts = (c.to_pylist() for c in batch.columns)
            for key, text in zip(zip(*key_columns, strict=True), texts, strict=True):
                if key != open_key:
                    if open_key is not None and open_key[2] is not None:
                        yield of_part()
                    elif open_key is not None:
                        close()
                    open_key, groups = key, groups + 1
                    if len(found) >= most or groups >= 0xFFFF:
                        yield passed()
                        groups = 1
                own: Counter = Counter()
                for token, n in Counter(_TOKEN.findall(text)).items():
                    for f in token_features(token):
                        own[f] += n
                held |= own  # the larger number of each
        if open_key is not None and open_key[2] is not None:
            yield of_part()
        elif open_key is not None:
            close()
        if found:
            yield passed()

    names = ["feature", "grp", "toxic", "n", *(f"c{j}" for j in range(2 * width))]
    ordered = rows.select("grp", "toxic", "part", "text").repartition("grp", "part").sortWithinPartitions("grp", "toxic", "part")
    seen = written(ordered.mapInArrow(run, "feature string, grp int, toxic int, n long, " + ", ".join(f"{c} long" for c in names[4:])), "toxicity-seen")
    split = seen.where("grp is not null").groupBy("feature", "grp", "toxic").agg(F.max("n").alias("n"))
    split = split.select("feature", *(((F.col("toxic") == t) & (F.col("n") >= times)).cast("long").alias(names[4 + width * (1 - t) + j]) for t in (1, 0) for j, times in enumerate(TIMES)))
    every = seen.where("grp is null").select("feature", *names[4:]).unionByName(split)
    return every.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[4:]))


def sure_features(counts: DataFrame, base: float) -> list[str]:
    """Features that mark toxic documents beyond doubt; they are as few as the bounded sample can prove."""
    width = len(TIMES)
    tests = max(counts.count(), 1) * width
    k, n = [F.col(f"c{j}") for j in range(width)], [F.col(f"c{j}") + F.col(f"c{width + j}") for j in range(width)]
    marks = reduce(Column.__or__, (beyond_doubt(a, b, base, tests) for a, b in zip(k, n, strict=True)))
    return sorted(r.feature for r in counts.where(marks).select("feature").collect())


def pieces(places: list[int], n: int, around: int = AROUND, longest: int = SPAN) -> list[tuple[int, int]]:
    """Stretches (start, end) of n tokens around all places; those that touch are one, up to `longest`."""
    out: list[list[int]] = []
    for i in places:
        a, b = max(0, i - around), min(n, i + around + 1)
        if out and a <= out[-1][1]:
            if b - out[-1][0] <= longest:
                out[-1][1] = b
                continue
            a = min(max(a, out[-1][1]), i)
            out[-1][1] = min(out[-1][1], a)
        out.append([a, b])
    return [(a, b) for a, b in out]


def learnt_pieces(rows: DataFrame, features: list[str]) -> DataFrame:
    """pattern and weight of all pieces of rows (share, toxic, text) around tokens with known features.

    A pattern is the label and, for each token, the numbers of its features; equal ones add up,
    as far as their documents count.
    """
    number = {f: i for i, f in enumerate(features)}

    def run(batch):
        found: Counter = Counter()
        known: dict[str, str] = {}
        for share, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kinds = []
            for t in _TOKEN.findall(text):
                if t not in known:
                    known[t] = ",".join(str(number[f]) for f in token_features(t) if f in number)
                kinds.append(known[t])
            for a, b in pieces([i for i, k in enumerate(kinds) if k], len(kinds)):
                found[f"{toxic};" + ";".join(kinds[a:b])] += share
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["pattern", "weight"])

    return per_batch(rows.select("share", "toxic", "text"), run, "pattern string, weight double").groupBy("pattern").agg(F.sum("weight").alias("weight"))


def fit(patterns: list[tuple[str, float]], features: list[str], rounds: int = 150, rate: float = 0.2, ridge: float = 1e-3, seed: int = 7) -> Field:
    """A field from learnt_pieces(), by Adam's steps on the likelihood of all pieces.

    Every piece comes twice, once with only the first features of each token, as many as chance
    wants, so that weights go to what words have in common and new forms of them are found.
    """
    patterns = sorted(patterns)
    parsed = [(p[0] == "1", [[int(f) + 1 for f in k.split(",")] if k else [] for k in p[2:].split(";")]) for p, _ in patterns]
    length, width = max(len(kinds) for _, kinds in parsed), max(len(k) for _, kinds in parsed for k in kinds)
    x = np.zeros((len(parsed), length, width), np.int64)  # 0 stands for no feature
    y = np.full((len(parsed), length), -1, np.int8)
    for r, (toxic, kinds) in enumerate(parsed):
        for i, k in enumerate(kinds):
            x[r, i, : len(k)] = k
            y[r, i] = bool(k) and toxic
    first = np.random.default_rng(seed).integers(1, width + 1, x.shape[:2])[:, :, None]
    first = 1 + (first - 1) % np.maximum((x > 0).sum(2, keepdims=True), 1)
    x = np.concatenate([x, np.where(np.arange(width)[None, None] < first, x, 0)])
    y = np.concatenate([y, y])
    mask = y >= 0
    each = np.array([w for _, w in patterns] * 2)
    each = each / each.sum()
    weights, moves, bias = np.zeros(len(features) + 1), np.zeros((2, 2)), -3.0
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros(5), np.zeros(5)]
    both = mask[:, 1:]
    seen = np.array([[(each[:, None] * (both & (y[:, :-1] == a) & (y[:, 1:] == b))).sum() for b in (0, 1)] for a in (0, 1)])
    for r in range(1, rounds + 1):
        emit = weights[x].sum(2) + bias
        p1, pairs = _expectations(emit, moves, mask, each)
        gap = np.where(mask, (y == 1) - p1, 0.0) * each[:, None]
        g_w = np.bincount(x.ravel(), np.repeat(gap.ravel(), width), len(weights)) - ridge * weights
        g_w[0] = 0
        g_s = np.append((seen - pairs).ravel(), gap.sum()) - ridge * np.append(moves.ravel(), 0)
        for k, g in ((0, g_w), (2, g_s)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
        steps = [rate * (state[k] / (1 - 0.9**r)) / (np.sqrt(state[k + 1] / (1 - 0.99**r)) + 1e-8) for k in (0, 2)]
        weights += steps[0]
        weights[0] = 0
        moves += steps[1][:4].reshape(2, 2)
        bias += steps[1][4]
    return Field({f: float(w) for f, w in zip(features, weights[1:], strict=True)}, float(bias), moves)


def fit_verdict(rows: list[tuple[int, float, int, float]], ridge: float = 1e-2) -> tuple[float, float, float]:
    """A logistic regression's weights from (tokens, expected toxic ones, label, weight) of
    documents with tagged tokens, by Newton's steps; none of the last two is negative, so that
    more toxic tokens never lower a score."""
    if not rows:
        return 0.0, 1.0, 0.0
    x = np.array([totals(n, s) for n, s, _, _ in rows])
    y, w = np.array([t for _, _, t, _ in rows], float), np.array([v for _, _, _, v in rows])
    w = w * len(w) / w.sum()
    used = [0, 1, 2]
    while True:
        b = np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, used] @ b, -40, 40)))
            g = x[:, used].T @ (w * (y - p)) - ridge * b
            h = (x[:, used] * (w * p * (1 - p))[:, None]).T @ x[:, used] + ridge * np.eye(len(used))
            step = np.linalg.solve(h, g)
            b = b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        lowest = min(used[1:], key=lambda j: b[used.index(j)], default=0)
        if not lowest or b[used.index(lowest)] >= 0:
            out = np.zeros(3)
            out[used] = b
            return tuple(out.tolist())
        used.remove(lowest)


def _expectations(emit: np.ndarray, moves: np.ndarray, mask: np.ndarray, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 and expected counts of label pairs, for all pieces at a time; each: their weights."""
    n, length = emit.shape
    each = np.ones(n) if each is None else each
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -40, 40))], 2)
    e[~mask] = 1.0
    move = np.exp(moves)
    forward, backward = np.empty((length, n, 2)), np.ones((length, n, 2))
    forward[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        m = np.where(mask[:, t, None], (forward[t - 1] @ move) * e[:, t], forward[t - 1])
        forward[t] = m / m.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        m = np.where(mask[:, t + 1, None], (backward[t + 1] * e[:, t + 1]) @ move.T, backward[t + 1])
        backward[t] = m / m.sum(1, keepdims=True)
    both = forward * backward
    p1 = (both[..., 1] / both.sum(2)).T
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        m = forward[t - 1][:, :, None] * move[None] * (e[:, t] * backward[t])[:, None, :]
        m /= m.sum((1, 2), keepdims=True)
        pairs += (m * (each * mask[:, t])[:, None, None]).sum(0)
    return p1, pairs


def held_out(key: Column) -> Column:
    """Whether a document's labels are kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _marks(docs: DataFrame, labels: DataFrame, row_bytes: int) -> DataFrame:
    """doc_id and toxic of the labels to learn from."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("n")).where(F.col("n") <= row_bytes).select("doc_id")
    return marks.join(sizes, "doc_id", "left_semi")


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, row_bytes: int = ROW_BYTES) -> list[tuple[int, int]]:
    """(doc_id, toxic) of a bounded sample of labelled rows, the same each time: of either label those with the least hashes.

    Only rows that are not held out; of several labels of a document the largest counts; other
    labels than 0 and 1 and texts of over row_bytes are not used.
    """
    return _sampled(_marks(docs, labels, row_bytes), toxic_rows, clean_rows)


def _sampled(marks: DataFrame, toxic_rows: int, clean_rows: int) -> list[tuple[int, int]]:
    some = lambda toxic, n: marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return sorted((r.doc_id, r.toxic) for r in some(1, toxic_rows).unionByName(some(0, clean_rows)).collect())


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, row_bytes: int = ROW_BYTES) -> Field:
    """The field of a bounded labelled sample; one that finds nothing if labels or marks are missing.

    Texts stay in tasks: to the driver go, for each of the sample's rows, its label, 16 hashes and
    its totals, and beside them the sure features and the distinct pieces around them.
    """
    spark = docs.sparkSession
    marks = written(_marks(docs, labels, row_bytes), "toxicity-labels")
    chosen = _sampled(marks, toxic_rows, clean_rows)
    drawn = Counter(t for _, t in chosen)
    if len(drawn) < 2:
        return Field()
    ids = F.broadcast(spark.createDataFrame([(d,) for d, _ in chosen], "doc_id long"))
    texts = doc_texts(docs).where(F.octet_length("text") <= row_bytes).join(ids, "doc_id")
    # rows repeated with one id count once
    texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "toxicity-sample").repartition(spark.sparkContext.defaultParallelism)

    def hashed(batch):
        return pa.record_batch([batch.column(0), pa.array([least_hashes(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "least"])

    hashes = {r.doc_id: r.least for r in per_batch(texts, hashed, "doc_id long, least array<long>").collect()}
    group_of = dict(zip(hashes, copy_groups(list(hashes.values())), strict=True))
    sizes = Counter((group_of[d], t) for d, t in chosen)
    witnesses = Counter(t for _, t in sizes)
    parts = {key: -(-n // GROUP_ROWS) for key, n in sizes.items()}
    known = [(d, t, group_of[d], 1 / sizes[group_of[d], t], i % parts[group_of[d], t] if parts[group_of[d], t] > 1 else None) for i, (d, t) in enumerate(chosen)]
    rows = written(texts.join(F.broadcast(spark.createDataFrame(known, "doc_id long, toxic int, grp int, share double, part int")), "doc_id"), "toxicity-rows")
    features = sure_features(written(feature_counts(rows), "toxicity-features"), witnesses[1] / len(sizes))
    found = [(r.pattern, r.weight) for r in learnt_pieces(rows, features).collect()] if features else []
    if not found:
        return Field()
    field = fit(found, features)

    def summed(batch):
        out = []
        for share, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, _, p = field.evidence(text)
            tagged = p[p >= TAGGED]
            if len(tagged):
                out.append((n, float(tagged.sum()), toxic, share))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.int32(), pa.float64()), strict=True)], ["n", "expected", "toxic", "share"]) if out else None

    # what a sampled document stands for
    every = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    stands = {t: every[t] / drawn[t] for t in drawn}
    evidence = per_batch(rows.select("share", "toxic", "text"), summed, "n long, expected double, toxic int, share double").collect()
    field.verdict = fit_verdict(sorted((r.n, r.expected, r.toxic, r.share * stands[r.toxic]) for r in evidence))
    return field


def score_documents(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id", with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) and, if asked, spans for every row.

    Null and empty texts score 0; null keys are never held out; repeated rows are scored each;
    further columns, whatever their names, are ignored; an empty table gives no rows; a text is
    read whole. spans: (start, end, probability) of the toxic tokens, by character.
    """
    schema = "doc_id long, score double" + ", spans array<struct<start:int,end:int,probability:double>>" * with_spans

    def run(batch):
        found = [field.judged(t) if with_spans else (field.score(t), None) for t in batch.column(1).to_pylist()]
        out = [batch.column(0), pa.array([s for s, _ in found], pa.float64())]
        if with_spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            out.append(pa.array([[{"start": a, "end": b, "probability": p} for a, b, p in spans] for _, spans in found], kind))
        return pa.record_batch(out, ["doc_id", "score", *["spans"] * with_spans])

    scored = per_batch(doc_texts(docs, text, key), run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *["spans"] * with_spans)


def drop_toxic(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; null and empty texts stay."""
    at = docs.columns.index("text")

    def run(batch):
        return batch.filter(pa.array([field.score(t or "") < THRESHOLD for t in batch.column(at).to_pylist()]))

    return per_batch(docs, run, docs.schema, "text")
