"""Schedules and graphs in one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenstep.functions.cost import transform
from evenstep.operators.loader import Loader, default_collate
from evenstep.operators.sampler import Sampler, permute
from evenstep.operators.schedule import Batching, schedule
from evenstep.sources.datasets import ChainDataset, ConcatDataset, Dataset, IterableDataset, getsizeof
from evenstep.sources.ingest import UnsupportedOperatorWarning
from evenstep.sources.ingest import ingest as serialize

__all__ = [
    "ChainDataset", "ConcatDataset", "Dataset", "IterableDataset", "Loader", "Sampler", "UnsupportedOperatorWarning", "default_collate",
    "getsizeof", "permute", "sched", "sched_unstable", "serialize",
]


def sched(positions: DataFrame, nodes: DataFrame, tensor_parallel: int, context_parallel: int, ranks: int, rank: int | None, global_batch: int, micro_batch: int, policy: str = "joint") -> DataFrame:
    """The stable schedule of positions (pos, idx, size) under a graph's cost, for one rank or (None) for all."""
    return schedule(positions, transform(nodes, tensor_parallel, context_parallel), Batching(ranks, global_batch, micro_batch, policy), True, rank)


def sched_unstable(positions: DataFrame, nodes: DataFrame, tensor_parallel: int, context_parallel: int, ranks: int, rank: int | None, global_batch: int, micro_batch: int, policy: str = "joint") -> DataFrame:
    """The unstable schedule likewise."""
    return schedule(positions, transform(nodes, tensor_parallel, context_parallel), Batching(ranks, global_batch, micro_batch, policy), False, rank)
