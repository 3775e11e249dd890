"""A loader: a dataset's batches in order, collated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evenstep.operators.collate import collate, fixed_batches
from evenstep.operators.sampler import Sampler, permute
from evenstep.sources.datasets import Dataset
from evenstep.storage import with_position


class Loader:
    """Batches of a dataset's columns.

    The order is the dataset's, a seeded permutation (shuffle), a sampler's share of one rank
    (sampler and rank), or given batches (batch_sampler: a table of batch, slot, idx). Batches
    have batch_size samples; drop_last leaves out a short last one; batch_size None gives samples
    one by one, as they are. rules replaces the concatenation of a column by an aggregate of one's
    own, collate_fn all of it: a function from rows (batch, slot and the columns) to batches. generator is
    a seed or has an initial_seed(). in_order=False gives batches as partitions have them.

    num_workers, prefetch_factor and persistent_workers are checked and need nothing further:
    Spark's tasks make batches in parallel and iteration fetches the next partition ahead. What
    has no meaning here is refused: a timeout, set-up of worker processes, pinned memory.
    """

    def __init__(
        self, dataset: Dataset, *columns: str, batch_size: int | None = 1, shuffle: bool | None = False, sampler: Sampler | None = None, rank: int | None = None,
        batch_sampler: DataFrame | None = None, drop_last: bool = False, seed: int = 0, rules: dict[str, Callable[[str], Column]] | None = None,
        num_workers: int = 0, collate_fn: Callable[[DataFrame], DataFrame] | None = None, pin_memory: bool = False, timeout: float = 0, worker_init_fn=None,
        multiprocessing_context=None, generator=None, prefetch_factor: int | None = None, persistent_workers: bool = False, pin_memory_device: str = "", in_order: bool = True,
    ):
        if sampler is not None and shuffle:
            raise ValueError("a sampler and shuffle exclude each other")
        if batch_sampler is not None and (batch_size != 1 or shuffle or sampler is not None or drop_last):
            raise ValueError("given batches exclude batch_size, shuffle, sampler and drop_last")
        if batch_size is None and (drop_last or rules):
            raise ValueError("without batches there is nothing to drop or to collate by rules")
        if batch_size is not None and batch_size <= 0:
            raise ValueError("batch_size must be positive")
        if num_workers < 0 or timeout < 0:
            raise ValueError("num_workers and timeout must not be negative")
        if num_workers == 0 and (prefetch_factor is not None or persistent_workers):
            raise ValueError("prefetch_factor and persistent_workers need workers")
        if collate_fn is not None and rules:
            raise ValueError("collate_fn and rules exclude each other")
        refused = {
            "timeout": (timeout, "a lost task is run again, however long it takes"), "worker_init_fn": (worker_init_fn, "Spark starts its own Python workers"),
            "multiprocessing_context": (multiprocessing_context, "Spark starts its own Python workers"), "pin_memory": (pin_memory, "rows come to the driver as Python objects"),
            "pin_memory_device": (pin_memory_device, "rows come to the driver as Python objects"),
        }
        for name, (value, why) in refused.items():
            if value:
                raise NotImplementedError(f"{name}: {why}")
        if generator is not None:
            seed = generator.initial_seed() if hasattr(generator, "initial_seed") else int(generator)
        if rank is None:
            rank = sampler.rank if sampler is not None and sampler.rank is not None else 0
        self.dataset, self.columns, self.batch_size, self.rules, self.collate_fn, self.in_order = dataset, columns, batch_size, rules, collate_fn, in_order
        self.shuffle, self.sampler, self.rank, self.batch_sampler, self.drop_last, self.seed = bool(shuffle), sampler, rank, batch_sampler, drop_last, seed

    def plan(self) -> DataFrame:
        """batch, slot, idx."""
        if self.batch_sampler is not None:
            return self.batch_sampler.select("batch", "slot", "idx")
        if self.sampler is not None:
            order = self.sampler.indices(self.rank).withColumnRenamed("place", "pos")
        else:
            order = permute(self.dataset.samples, self.seed, shuffle=self.shuffle).select("pos", "idx")
        return fixed_batches(order, self.batch_size or 1, self.drop_last).select("batch", "slot", "idx")

    def batches(self) -> DataFrame:
        """One row per batch: batch and the collated columns. One join and one aggregate."""
        rows = self.plan().join(self.dataset.rows.select("idx", *self.columns), "idx")
        if self.batch_size is None:
            return rows.select("batch", *self.columns)
        if self.collate_fn is not None:
            return self.collate_fn(rows)
        return collate(rows, *self.columns, by=("batch",), rules=self.rules)

    def __len__(self) -> int:
        if self.batch_sampler is not None:
            return self.batch_sampler.select("batch").distinct().count()
        n, size = len(self.sampler) if self.sampler is not None else len(self.dataset), self.batch_size or 1
        return n // size if self.drop_last else -(-n // size)

    def __iter__(self) -> Iterator[Row]:
        """Batches in order, a partition at a time."""
        if not self.in_order:
            return self.batches().toLocalIterator(prefetchPartitions=True)
        ordered = with_position(self.batches(), "batch", name="place").repartitionByRange("place").sortWithinPartitions("place")
        return ordered.drop("place").toLocalIterator(prefetchPartitions=True)


def default_collate(rows: DataFrame, *columns: str, by: str = "batch") -> DataFrame:
    """collate() of batches that are named by one column."""
    return collate(rows.where(F.col(by).isNotNull()), *columns, by=(by,))
