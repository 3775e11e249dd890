"""Streams of samples: chains of sources, and schedules of each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from evenstep.functions.polynomial import Polynomial
from evenstep.operators.sampler import resize, total_size
from evenstep.operators.schedule import Batching, stable_schedule
from evenstep.sources.datasets import chain
from evenstep.storage import with_position

__all__ = ["chain", "schedule_stream"]


def schedule_stream(samples: DataFrame, cost: Polynomial, batch: Batching, sink: Callable[[DataFrame, int], None], drop_last: bool = False) -> DataStreamWriter:
    """A writer that gives sink the stable schedule of each batch of a stream (idx, size).

    Positions are counted within the batch, in the order of idx; what doesn't fill all ranks is
    dropped or filled up from the batch's start. An empty batch gives an empty schedule.
    """

    def each(rows: DataFrame, number: int) -> None:
        placed = with_position(rows.select("idx", "size"), "idx", "size")
        n = placed.count()
        sink(stable_schedule(resize(placed, n, total_size(n, batch.ranks, drop_last)), cost, batch), number)

    return samples.writeStream.foreachBatch(each)
