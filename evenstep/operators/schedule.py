"""Schedules: which sample goes to which rank, step, micro-batch and slot.

The input is positions (pos, idx, size); the result has a row for every sample of every rank.
Stable schedules regroup within each step's global batch; unstable ones regroup all samples.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.functions.polynomial import Polynomial
from evenstep.operators.partition import partition
from evenstep.storage import with_position, written

log = logging.getLogger(__name__)

POLICIES = ("fast", "mem", "joint")
SCHEDULE = "step long, rank int, micro int, slot int, pos long, idx long, size long, cost long"
#: Batches, and items, that one task regroups in an unstable schedule; the samples are dealt to as many tasks as that takes.
MOST_BATCHES, MOST_ITEMS = 1024, 4_000_000


@dataclass(frozen=True)
class Batching:
    """Ranks (R), samples of a step over all ranks (G), samples of a micro-batch (M), policy.

    policy: 'fast' balances by cost, 'mem' by size, 'joint' ranks by size and micro-batches by cost.
    """

    ranks: int
    global_batch: int
    micro_batch: int
    policy: str = "joint"

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if self.ranks <= 0 or self.global_batch <= 0 or self.micro_batch <= 0:
            raise ValueError("ranks, global batch and micro-batch must be positive")
        if self.global_batch % self.ranks:
            raise ValueError("the global batch must be a multiple of the ranks")

    @property
    def by_size(self) -> bool:
        """Whether samples are dealt to ranks by size."""
        return self.policy != "fast"


def micro_batches(sizes: np.ndarray, costs: np.ndarray, batch: Batching) -> list[np.ndarray]:
    """A rank's batch as micro-batches of item numbers.

    The largest items that don't fill a micro-batch come last; the others are balanced by the
    policy's key, in ascending order of their cost.
    """
    key = sizes if batch.policy == "mem" else costs
    order = np.lexsort((np.arange(len(key)), key))
    tail = len(order) % batch.micro_batch
    whole, rest = order[: len(order) - tail], order[len(order) - tail :]
    groups = [whole[g] for g in partition(key[whole], len(whole) // batch.micro_batch)]
    if batch.policy == "mem":
        groups.sort(key=lambda g: int(costs[g].sum()))
    return groups + [rest] * (tail > 0)


def _rows(step: int, rank: int, of: np.ndarray, sizes: np.ndarray, costs: np.ndarray, batch: Batching) -> list[np.ndarray]:
    """Columns step, rank, micro, slot and item number of one rank's batch."""
    out = []
    for m, group in enumerate(micro_batches(sizes[of], costs[of], batch)):
        n = len(group)
        out.append(np.stack([np.full(n, step), np.full(n, rank), np.full(n, m), np.arange(n), of[group]]))
    return out


def _as_batch(rows: list[np.ndarray], pos, idx, sizes, costs) -> pa.RecordBatch:
    step, rank, micro, slot, at = np.concatenate(rows, 1)
    columns = [pa.array(step), *(pa.array(c.astype(np.int32)) for c in (rank, micro, slot)), *(pa.array(c[at]) for c in (pos, idx, sizes, costs))]
    return pa.record_batch(columns, ["step", "rank", "micro", "slot", "pos", "idx", "size", "cost"])


def by_group(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[np.ndarray]:
    """Columns (group, pos, idx, size, cost) of sorted rows, in pieces of whole groups."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if rows >= least:
            same = int(np.searchsorted(new[0], held[-1][0, -1], "right"))  # rows of the group that is open
            if same < new.shape[1]:
                yield np.concatenate([*held, new[:, :same]], 1)
                held, rows, new = [], 0, new[:, same:]
        held.append(new)
        rows += new.shape[1]
    if held:
        yield np.concatenate(held, 1)


def cut(group: np.ndarray) -> list[tuple[int, int]]:
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def _checked(positions: DataFrame, cost: Polynomial, batch: Batching) -> tuple[DataFrame, int]:
    rows = positions.select(F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"), F.col("size").cast("long").alias("size"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count("size").alias("sized")).first()
    if found.sized != found.n:
        raise ValueError("every sample needs a size")
    if found.n % batch.ranks:
        raise ValueError("the number of samples must be a multiple of the ranks")
    return rows.withColumn("cost", cost.at(F.col("size"))), found.n


def stable_schedule(positions: DataFrame, cost: Polynomial, batch: Batching) -> DataFrame:
    """SCHEDULE for positions (pos, idx, size): step t has the positions t*G to (t+1)*G - 1.

    Within a step, samples are dealt to ranks in groups whose sums of the policy's key ascend
    with the rank. The last step may be short. One shuffle by step; a task handles many steps.
    """
    rows, _ = _checked(positions, cost, batch)
    rows = rows.withColumn("step", F.call_function("div", F.col("pos"), F.lit(batch.global_batch)))

    def run(batches):
        for step, pos, idx, sizes, costs in by_group(batches):
            out = []
            for a, b in cut(step):
                key = (sizes if batch.by_size else costs)[a:b]
                order = a + np.lexsort((idx[a:b], sizes[a:b], key))
                share = sizes if batch.by_size else costs
                for rank, group in enumerate(partition(share[order], batch.ranks)):
                    out += _rows(int(step[a]), rank, order[group], sizes, costs, batch)
            yield _as_batch(out, pos, idx, sizes, costs)

    return rows.select("step", "pos", "idx", "size", "cost").repartition("step").sortWithinPartitions("step", "pos").mapInArrow(run, SCHEDULE)


def _unstable(rows: DataFrame, n: int, batch: Batching, first_step: int, most_items: int) -> DataFrame:
    """Rows (pos, idx, size, cost), a multiple of the global batch, regrouped as a whole."""
    each = batch.global_batch // batch.ranks
    if not each:
        return rows.sparkSession.createDataFrame([], SCHEDULE)
    key = "size" if batch.by_size else "cost"
    batches_n = n // each
    dealt = min(max(-(-batches_n // MOST_BATCHES), -(-n // most_items)), batches_n)
    # each round of the sorted order gives an item to every batch; rounds run to and fro over the parts
    ordered = with_position(rows, key, "size", "idx", "pos", name="place") if dealt > 1 else rows.withColumn("place", F.lit(0).cast("long"))
    turn, slot = F.call_function("div", F.col("place"), F.lit(batches_n).cast("long")), F.pmod("place", F.lit(batches_n).cast("long"))
    part = F.pmod(F.when(turn % 2 == 1, batches_n - 1 - slot).otherwise(slot), F.lit(dealt).cast("long"))

    def run(pieces):
        for part_no, pos, idx, sizes, costs in by_group(pieces):
            for a, b in cut(part_no):
                share = (sizes if batch.by_size else costs)[a:b]
                order = a + np.lexsort((pos[a:b], idx[a:b], sizes[a:b], share))
                groups = order[partition((sizes if batch.by_size else costs)[order], (b - a) // each)]
                number = np.repeat(np.arange(len(groups)), each) + (int(part_no[a]) << 40)
                at = groups.ravel()
                yield pa.record_batch([pa.array(c) for c in (number, pos[at], idx[at], sizes[at], costs[at])], ["batch", "pos", "idx", "size", "cost"])

    grouped = ordered.select(part.cast("long").alias("part"), "pos", "idx", "size", "cost").repartitionById(dealt, F.col("part").cast("int")).sortWithinPartitions("part")
    grouped = written(grouped.mapInArrow(run, "batch long, pos long, idx long, size long, cost long"), "batches")
    # batches in ascending order; joint sorts those that were balanced by size by their cost
    rank_by = "size" if batch.policy == "mem" else "cost"
    sums = grouped.groupBy("batch").agg(F.sum(rank_by).alias("total"))
    numbered = with_position(sums, "total", "batch", name="number").select("batch", "number")
    r = F.lit(batch.ranks).cast("long")

    def split(pieces):
        for number, pos, idx, sizes, costs in by_group(pieces):
            out = []
            for a, b in cut(number):
                t = int(number[a])
                out += _rows(first_step + t // batch.ranks, t % batch.ranks, np.arange(a, b), sizes, costs, batch)
            yield _as_batch(out, pos, idx, sizes, costs)

    joined = grouped.join(numbered, "batch").select("number", "pos", "idx", "size", "cost")
    return joined.repartition("number").sortWithinPartitions("number", "size", "idx", "pos").mapInArrow(split, SCHEDULE)


def unstable_schedule(positions: DataFrame, cost: Polynomial, batch: Batching, most_items: int = MOST_ITEMS) -> DataFrame:
    """SCHEDULE for positions: all samples are regrouped, so a step can have samples of any position.

    Batches of G/R samples ascend by their sum; step t gives rank r the batch t*R + r. What is
    left of a multiple of G comes last, regrouped by itself. A task regroups up to MOST_BATCHES
    batches and most_items samples: the sorted samples are dealt evenly, to and fro, to as many
    parts as that takes, which keeps cardinalities, the order of batches and nearly equal sums.
    """
    rows, n = _checked(positions, cost, batch)
    whole = n - n % batch.global_batch
    out = None
    if whole:
        out = _unstable(rows.where(F.col("pos") < whole), whole, batch, 0, most_items)
    if n > whole:
        last = Batching(batch.ranks, n - whole, batch.micro_batch, batch.policy)
        rest = _unstable(rows.where(F.col("pos") >= whole), n - whole, last, whole // batch.global_batch, most_items)
        out = rest if out is None else out.unionByName(rest)
    return positions.sparkSession.createDataFrame([], SCHEDULE) if out is None else out


def schedule(positions: DataFrame, cost: Polynomial, batch: Batching, stable: bool = False, rank: int | None = None) -> DataFrame:
    """The schedule of all ranks, or of one."""
    if rank is not None and not 0 <= rank < batch.ranks:
        raise ValueError("rank must be one of the ranks")
    out = stable_schedule(positions, cost, batch) if stable else unstable_schedule(positions, cost, batch)
    return out if rank is None else out.where(F.col("rank") == rank)


def micro_batch_count(n: int, batch: Batching) -> int:
    """Micro-batches of n samples over all ranks, as if a rank's samples were cut once."""
    return -(-(n // batch.ranks) // batch.micro_batch) * batch.ranks


def finished(schedule: DataFrame, n: int, batch: Batching) -> DataFrame:
    """A schedule of n samples as a table, with a log entry on the micro-batches and the time that making it took."""
    began = time.time()
    out = written(schedule, "schedule")
    log.info("Reordering %d micro-batches took %.3f s", micro_batch_count(n, batch), time.time() - began)
    return out
