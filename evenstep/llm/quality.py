"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose figure is above a cutoff. Cutoffs come from labelled holdouts.
In every stratum the bad holdouts and a third of the good ones give a list of cutoffs, the surest
first. The other good holdouts then test the rules together: cutoffs of the list are added one by
one, as long as an exact binomial bound says that all so far would reject at most a set share of
good documents. The rules share that bound; the error probability is divided among strata only.
The bounds need independent witnesses, so of near copies with one label only one counts.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import per_batch, written
from evenstep.llm.witnesses import least_hashes, witness_groups

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: The rules' figures: shares of word characters (symbols, capitals, exclamation marks), of
#: lines (repeated), of words (repeated), and characters a word.
RULES = ("symbols", "capitals", "marks", "dup_lines", "repeats", "length")
#: Steps of a figure's scale; cutoffs lie between them.
STEPS = {r: 10 if r == "length" else 500 for r in RULES}
TOP = 1000
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"
ALPHA, DELTA = 0.03, 0.05
#: A helper column, unlike any of a table's own.
KEY = "__evenstep_key"
#: Labelled ids (8 bytes each) up to which they are broadcast, so that only labelled texts are read closely.
MOST_BROADCAST = 500_000


def repeated_words(words: list, width: int = 3) -> int:
    """Words that stand in a run of `width` words which the list has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    keys = ids[: n - width + 1]
    for k in range(1, width):  # numbers of shorter runs stay below n, so the products are exact
        keys = keys * n + ids[k : n - width + 1 + k]
        if k < width - 1 and n > 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def features(text: str) -> tuple[int, ...]:
    """The values of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen, n_dup, n_lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), n_dup, repeated_words(words),
        n_lines, len(data) - len(data.translate(None, _CAPITALS)), data.count(b"!"),
    )


_CAPITALS = bytes(range(65, 91))


def document_features(docs: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", with_hashes: bool = False) -> DataFrame:
    """doc_id, stratum and FEATURES for every row; null text has no words, a null stratum is ''.
    On request also least (array): least_hashes() of the text."""

    def run(batch):
        texts = batch.column(2).to_pylist()
        columns = [pa.array(c, pa.int64()) for c in zip(*map(features, texts), strict=True)]
        if with_hashes:
            columns.append(pa.array([least_hashes(t) for t in texts], pa.list_(pa.int64())))
        return pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "stratum", *(x.split()[0] for x in FEATURES.split(", ")), *["least"] * with_hashes])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return per_batch(rows, run, f"doc_id long, stratum string, {FEATURES}" + ", least array<long>" * with_hashes)


def figures() -> dict[str, Column]:
    """Each rule's figure in steps, from the columns of FEATURES."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    raw = {"symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"), "marks": share("n_marks", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "length": share("word_chars", "n_words")}
    return {r: F.least(F.floor(raw[r] * STEPS[r]), F.lit(TOP)).cast("int") for r in RULES}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k of n events that each have probability p."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def choose(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, near_best: float = 0.98, worth: float = 10.0) -> int | None:
    """One rule on its own: the cutoff for counts of good and bad holdouts by step; None if none is certain or useful.

    Cutoffs are tested from the laxest on and testing ends with the first that fails, so each
    test may use all of delta. A cutoff passes if the exact upper bound of the share of good
    documents above it is at most alpha. A rule must also be worth its errors: of the cutoffs
    that passed and catch `worth` bad documents for each good one, the laxest is taken that
    catches near_best of what the best of them does.
    """
    n = int(good.sum())
    if not n:
        return None
    above = lambda x: np.append(np.cumsum(x[::-1])[::-1][1:], 0)
    good_above, bad_above = above(good), above(bad)
    passed, result = [], {}
    for c in range(len(good) - 1, -1, -1):
        k = int(good_above[c])
        if k not in result:
            result[k] = k < n and at_most(k, n, alpha) <= delta
        if not result[k]:
            break
        if bad_above[c] >= worth * max(k, 1):
            passed.append(c)
    if not passed:
        return None
    want = near_best * max(bad_above[c] for c in passed)
    return max(c for c in passed if bad_above[c] >= want)


def proposals(tables: dict[str, tuple[np.ndarray, np.ndarray]], scale: float, alpha: float, worth: float = 10.0, near_best: float = 0.98, fewest_bad: int = 3) -> list[tuple[str, int]]:
    """(rule, cutoff) in the order in which cutoffs are to be tested, from counts of good and bad
    holdouts by rule and step; `scale` is how many good holdouts a counted one stands for.

    First each rule's cutoff that rejects none of the counted good holdouts, then its stricter
    one that catches `worth` bad documents for each good one; of either kind the laxest that
    catches near_best of what the best does. The former go by how far above all counted good ones
    their cutoff is, as others may exceed these a little; the latter by good documents.
    """
    above = lambda x: np.append(np.cumsum(x[::-1])[::-1][1:], 0)
    found = []
    for at, (rule, (good, bad)) in enumerate(tables.items()):
        k, caught = above(good) * scale, above(bad)
        useful = caught >= fewest_bad
        for level, able in enumerate((useful & (k == 0), useful & (k <= alpha * good.sum() * scale) & (caught >= worth * k))):
            if able.any():
                c = int(np.flatnonzero(able & (caught >= near_best * caught[able].max()))[-1])
                apart = (c + 1) / (int(np.flatnonzero(able)[0]) + 1)
                found.append((level, float(k[c]) if level else -apart, -int(caught[c]), at, rule, c))
    out: dict = {}
    path = []
    for _, _, _, _, rule, c in sorted(found):
        if c < out.get(rule, TOP + 1):  # a laxer cutoff adds nothing
            out[rule] = c
            path.append((rule, c))
    return path


def accepted(path: list[tuple[str, int]], good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> dict[str, int]:
    """The cutoffs of the longest beginning of path whose rules together hold the bound.

    good, bad: holdouts by the first entry of path that rejects them; the last count is of those
    that none rejects. The list is fixed before the good ones are seen and testing ends with the
    first failure, so each test may use all of delta. Entries that catch no more bad documents
    go, which rejects fewer good ones.
    """
    n, k, out = int(good.sum()), 0, {}
    for i, (rule, c) in enumerate(path):
        k += int(good[i])
        if k >= n or at_most(k, n, alpha) > delta:
            break
        if bad[i]:
            out[rule] = c
    return out


def testable(sizes: dict[str, tuple[int, int]], alpha: float, delta: float) -> dict[str, tuple[int, int]]:
    """Of strata with (seen, tests) good holdouts the most that can each pass a test at their part of delta."""
    order = sorted(sizes, key=lambda s: (-sizes[s][1], s))
    most = max((i for i, s in enumerate(order, 1) if sizes[s][1] >= log(delta / i) / log1p(-alpha)), default=0)
    return {s: sizes[s] for s in order[:most]}


def holdouts(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """stratum, part (0 bad, 1 good for the list, 2 good for the tests) and step (each rule's
    figure) of labelled documents that the base rules keep, one for each label of each group of
    near copies: the row whose doc_id has the least hash. labels: doc_id, quality 0 or 1.

    A group's good document is for the list or for the tests by the hash of the group. Ids that
    are too many to broadcast are joined to the features of all documents.
    """
    quality = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    quality = written(quality, "quality-labels")
    ids = quality.select(F.col("doc_id").alias(KEY))
    if quality.count() <= most_broadcast:
        docs = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col(KEY), "left_semi")
    found = document_features(docs, with_hashes=True).where(~base_failed()).join(quality, "doc_id")
    found = written(found.select("doc_id", "stratum", "quality", "least", F.struct(*(c.alias(r) for r, c in figures().items())).alias("step")), "quality-labelled")
    groups = witness_groups(found.select("doc_id", "least"))
    part = F.when(F.col("quality") == 0, 0).when(F.pmod(F.xxhash64("group"), F.lit(3)) == 0, 1).otherwise(2).alias("part")
    each = found.join(groups, "doc_id").select("group", "quality", part, F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id", "stratum", "step").alias("row"))
    return each.groupBy("group", "quality", "part").agg(F.min("row").alias("row")).select("row.stratum", "part", "row.step")


def thresholds(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """Cutoffs by stratum and rule from all labelled rows (labels: doc_id, quality 0 or 1).

    Strata with too few good holdouts to be certain of anything get no cutoffs, which also bounds
    what goes to the driver: counts for at most (good holdouts / fewest) strata.
    """
    fewest = int(log(delta) / log1p(-alpha))
    held = written(holdouts(docs, labels), "quality-holdouts")
    enough = held.groupBy("stratum").agg(F.count_if(F.col("part") == 1).alias("seen"), F.count_if(F.col("part") == 2).alias("tests")).where((F.col("tests") >= fewest) & (F.col("seen") > 0))
    sizes = testable({r.stratum: (r.seen, r.tests) for r in enough.collect()}, alpha, delta)
    if not sizes:
        return {}
    names = F.broadcast(held.sparkSession.createDataFrame([(s,) for s in sizes], "stratum string"))
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"step.{r}").alias("at")) for r in RULES)))
    counts = held.where("part < 2").join(names, "stratum").select("stratum", "part", steps.alias("x")).groupBy("stratum", "part", "x.rule", "x.at").agg(F.count(F.lit(1)).alias("n"))
    tables: dict = {s: {r: (np.zeros(TOP + 1, np.int64), np.zeros(TOP + 1, np.int64)) for r in RULES} for s in sizes}
    for r in counts.collect():
        tables[r.stratum][r.rule][0 if r.part else 1][r.at] = r.n
    paths = {s: proposals(t, sum(sizes[s]) / sizes[s][0], alpha) for s, t in tables.items()}
    lists = held.sparkSession.createDataFrame([(s, [(i, rule, c) for i, (rule, c) in enumerate(p)]) for s, p in paths.items()], "stratum string, path array<struct<i: int, rule: string, cutoff: int>>")
    figure = F.create_map(*(x for r in RULES for x in (F.lit(r), F.col(f"step.{r}"))))
    hit = F.filter("path", lambda x: figure[x["rule"]] > x["cutoff"])
    first = F.coalesce(F.get(hit, F.lit(0))["i"], F.size("path")).alias("first")
    tested = held.where("part <> 1").join(F.broadcast(lists), "stratum").select("stratum", "part", first).groupBy("stratum", "part", "first").agg(F.count(F.lit(1)).alias("n"))
    firsts = {s: np.zeros((3, len(p) + 1), np.int64) for s, p in paths.items()}
    for r in tested.collect():
        firsts[r.stratum][r.part, r.first] = r.n
    return {s: accepted(p, firsts[s][2], firsts[s][0], alpha, delta / len(sizes)) for s, p in paths.items()}


def rejected_by_rule(cutoffs: dict[str, dict[str, int]]) -> Column:
    """Whether a rule of a row's stratum rejects it, from the columns of document_features()."""
    out, by_rule = F.lit(False), figures()
    for stratum, rules in sorted(cutoffs.items()):
        for rule, c in sorted(rules.items()):
            out = out | ((F.col("stratum") == stratum) & (by_rule[rule] > c))
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    cutoffs (those of the row's stratum, as "rule>cutoff", comma-joined; '' where it has none) for every row.

    Null and empty texts have no words and fail the base rules. Null keys have no label, repeated
    rows are judged each, a null language is a stratum of its own, labels other than 0 and 1
    and of unknown documents are ignored, of several labels of a document the least counts; of
    near copies with one label one counts. Further columns, whatever their names, are ignored.
    An empty table gives no rows; without enough labels only the base rules reject.
    """
    cutoffs = thresholds(docs, labels, alpha, delta)
    kept = ~(base_failed() | rejected_by_rule(cutoffs))
    named = F.lit("")
    for stratum, rules in sorted(cutoffs.items()):
        named = F.when(F.col("stratum") == stratum, ",".join(f"{r}>{c}" for r, c in sorted(rules.items()))).otherwise(named)
    return document_features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), named.alias("cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs, all columns, that the base rules and the chosen thresholds keep.

    docs needs the columns doc_id, text and lang. Edge cases are those of quality_verdicts().
    """
    cutoffs = thresholds(docs, labels, alpha, delta)
    at_text, at_stratum = docs.columns.index("text"), docs.columns.index("lang")

    def run(batch):
        texts = [t or "" for t in batch.column(at_text).to_pylist()]
        strata = [s or "" for s in batch.column(at_stratum).to_pylist()]
        return batch.filter(pa.array([keeps(features(t), cutoffs.get(s, {})) for t, s in zip(texts, strata, strict=True)]))

    return per_batch(docs, run, docs.schema, "text")


def keeps(f: tuple[int, ...], rules: dict[str, int]) -> bool:
    """One document's verdict from its features; the same as base_failed() and rejected_by_rule()."""
    n_words, chars, n_symbols, n_dup, n_repeat, n_lines, capitals, marks = f
    if n_words < 50 or 100 * n_repeat > 50 * n_words:
        return False
    raw = {"symbols": n_symbols / max(chars, 1), "capitals": capitals / max(chars, 1), "marks": marks / max(chars, 1), "dup_lines": n_dup / max(n_lines, 1), "repeats": n_repeat / max(n_words, 1), "length": chars / max(n_words, 1)}
    return all(min(int(raw[r] * STEPS[r]), TOP) <= c for r, c in rules.items())
