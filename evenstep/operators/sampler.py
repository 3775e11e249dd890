"""Seeded order, padding, trimming and sharding of samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.functions.cost import transform
from evenstep.functions.polynomial import Polynomial
from evenstep.operators.schedule import Batching, finished, schedule
from evenstep.sources.datasets import Dataset
from evenstep.storage import with_position


def permute(samples: DataFrame, seed: int = 0, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """pos, idx and size of samples (idx, size): in the order of md5(seed + epoch ':' idx), or of idx."""
    rows = samples.select(F.col("idx").cast("long").alias("idx"), F.col("size").cast("long").alias("size"))
    if not shuffle:
        return with_position(rows, "idx").select("pos", "idx", "size")
    mixed = rows.withColumn("mix", F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col("idx").cast("string"))))
    return with_position(mixed, "mix", "idx").select("pos", "idx", "size")


def total_size(n: int, ranks: int, drop_last: bool = False) -> int:
    """Samples of all ranks: n cut, or filled up, to a multiple of the ranks."""
    return n // ranks * ranks if drop_last else -(-n // ranks) * ranks


def resize(positions: DataFrame, n: int, total: int) -> DataFrame:
    """The first `total` of n positions; if there are fewer, all again from the start until there are enough."""
    if total <= n or not n:
        return positions.where(F.col("pos") < total)
    again = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.lit(total - 1).cast("long") - F.col("pos"), F.lit(n).cast("long")))
    return positions.select(F.explode(again).alias("round"), "pos", "idx", "size").select((F.col("pos") + F.col("round") * n).alias("pos"), "idx", "size")


@dataclass
class Sampler:
    """A dataset's schedule, epoch by epoch.

    samples is a dataset or a table of idx and size; cost is a model's graph (a node table), whose
    cost is scaled to the parallel sizes, or a polynomial that is ready. drop_last drops what does
    not fill all ranks, else the first samples come again. unstable regroups all samples, else each
    step's. Iteration gives the idx of `rank` in order.
    """

    samples: DataFrame | Dataset
    cost: Polynomial | DataFrame
    ranks: int
    global_batch: int
    micro_batch: int
    shuffle: bool = True
    seed: int = 0
    drop_last: bool = False
    unstable: bool = True
    policy: str = "joint"
    epoch: int = 0
    tensor_parallel: int = 1
    context_parallel: int = 1
    rank: int | None = None

    def __post_init__(self):
        if self.rank is not None and not 0 <= self.rank < self.ranks:
            raise ValueError("rank must be one of the ranks")
        if isinstance(self.samples, Dataset):
            self.samples = self.samples.samples
        if isinstance(self.cost, DataFrame):
            self.cost = transform(self.cost, self.tensor_parallel, self.context_parallel)
        elif self.tensor_parallel != 1 or self.context_parallel != 1:
            raise ValueError("parallel sizes belong to a graph; a polynomial is taken as it is")
        self.batching = Batching(self.ranks, self.global_batch, self.micro_batch, self.policy)
        self.n = self.samples.count()

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    @property
    def total(self) -> int:
        return total_size(self.n, self.ranks, self.drop_last)

    def __len__(self) -> int:
        """Samples of each rank."""
        return self.total // self.ranks

    def positions(self) -> DataFrame:
        return resize(permute(self.samples, self.seed, self.epoch, self.shuffle), self.n, self.total)

    def schedule(self, rank: int | None = None) -> DataFrame:
        """All ranks' rows, or one's: step, rank, micro, slot, pos, idx, size, cost."""
        return schedule(self.positions(), self.cost, self.batching, not self.unstable, rank)

    def indices(self, rank: int) -> DataFrame:
        """A rank's idx in order: its place is `place`."""
        own = finished(self.schedule(rank), self.total, self.batching)
        return with_position(own, "step", "micro", "slot", name="place").select("place", "idx")

    def __iter__(self) -> Iterator[int]:
        """The idx of the sampler's own rank, a partition at a time."""
        if self.rank is None:
            raise ValueError("only a sampler with a rank can be iterated")
        ordered = self.indices(self.rank).repartitionByRange("place").sortWithinPartitions("place")
        n = 0
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            n += 1
            yield row.idx
        if n != len(self):
            raise AssertionError("a rank has another number of samples than its share")
