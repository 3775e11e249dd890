"""Balanced groups of a table's rows, for tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.operators.partition import Block, combined, partition
from evenstep.operators.schedule import MOST_ITEMS, by_group, cut
from evenstep.storage import with_position, written


def balanced_groups(samples: DataFrame, k: int, heuristic: str = "meld", most_items: int = MOST_ITEMS) -> DataFrame:
    """place, idx, size: samples (idx, size) in k groups of equal cardinality and nearly equal sums,
    numbered in ascending order of the sums.

    Up to most_items samples are one task's. Of more, the sorted samples are dealt to parts, a group's worth
    or a block of k at a time, to and fro. If there are at least as many groups as parts, each
    part makes groups of its own; else each makes k groups, whose sums (fewer than parts * parts)
    are combined on the driver by the same rule. No rows: an empty result.
    """
    rows = samples.select(F.col("idx").cast("long").alias("idx"), F.col("size").cast("long").alias("size"))
    n = rows.count()
    if k <= 0 or n % k:
        raise ValueError("the number of samples must be a multiple of the number of groups")
    parts = max(-(-n // most_items), 1)
    own = k >= parts
    width = F.lit(k).cast("long")
    turn, slot = F.call_function("div", F.col("pos"), width), F.pmod("pos", width)
    # parts with groups of their own take places of every round, others whole rounds
    at, every = (slot, turn % 2 == 1) if own else (turn, F.call_function("div", turn, F.lit(parts).cast("long")) % 2 == 1)
    mirrored = F.when(every, F.lit(k - 1) - at).otherwise(at) if own else F.when(every, F.lit(parts - 1) - F.pmod(at, F.lit(parts))).otherwise(F.pmod(at, F.lit(parts)))
    part = F.pmod(mirrored, F.lit(parts)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]):
        for part_no, _, idx, sizes in by_group(batches):
            for a, b in cut(part_no):
                groups = partition(sizes[a:b], (b - a) // (n // k) if own else k, heuristic)
                place, at = np.repeat(np.arange(len(groups)), groups.shape[1]), a + groups.ravel()
                yield pa.record_batch([pa.array(np.full(len(at), part_no[a])), pa.array(place), pa.array(idx[at]), pa.array(sizes[at])], ["part", "within", "idx", "size"])

    dealt = with_position(rows, "size", "idx", name="pos").select(part.cast("long").alias("part"), "pos", "idx", "size")
    dealt = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "pos")
    made = written(dealt.mapInArrow(run, "part long, within long, idx long, size long"), "groups")
    sums = made.groupBy("part", "within").agg(F.sum("size").alias("total"))
    if own:
        places = with_position(sums, "total", "part", "within", name="place").select("part", "within", "place")
    else:
        found: dict[int, list[tuple[int, int]]] = {}
        for r in sums.collect():
            found.setdefault(r.part, []).append((r.within, r.total))
        blocks = []
        for p, of in sorted(found.items()):
            totals = np.array([t for _, t in sorted(of)], np.int64)
            blocks.append(Block(totals, (np.arange(k) + p * k)[:, None]))
        table = [(int(x) // k, int(x) % k, place) for place, row in enumerate(combined(blocks, heuristic).members if blocks else []) for x in row]
        places = F.broadcast(made.sparkSession.createDataFrame(table, "part long, within long, place long"))
    return made.join(places, ["part", "within"]).select("place", "idx", "size")
