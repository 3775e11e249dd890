"""Datasets: sized samples, concatenation with offsets, and chains."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def samples_from(df: DataFrame, idx: str | Column, size: Column | None) -> DataFrame:
    """idx and size (bigint) of df; a dataset must say what its samples' sizes are."""
    if size is None:
        raise NotImplementedError("a dataset needs an expression for its samples' sizes")
    return df.select((F.col(idx) if isinstance(idx, str) else idx).cast("long").alias("idx"), size.cast("long").alias("size"))


def lengths(*datasets: DataFrame) -> list[int]:
    return [d.count() for d in datasets]


def concat(*datasets: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """Samples one dataset after the other: idx is shifted by the rows before; source and local idx beside it.

    sizes spares counting if the numbers of rows are known.
    """
    if not datasets:
        raise ValueError("datasets should not be empty")
    before, parts = 0, []
    for k, (d, n) in enumerate(zip(datasets, sizes or lengths(*datasets), strict=True)):
        parts.append(d.select((F.col("idx") + before).alias("idx"), "size", F.lit(k).alias("source"), F.col("idx").alias("local_idx")))
        before += n
    return reduce(DataFrame.unionByName, parts)


def locate(sizes: list[int], index: int) -> tuple[int, int]:
    """(dataset, local index) of an index into the concatenation; a negative one counts from the end."""
    total = sum(sizes)
    if not -total <= index < total:
        raise ValueError("index is out of range")
    index += total if index < 0 else 0
    for k, n in enumerate(sizes):
        if index < n:
            return k, index
        index -= n
    raise AssertionError


def size_at(datasets: list[DataFrame], index: int, sizes: list[int] | None = None) -> int:
    """The size of one sample of the concatenation: a filter on one dataset."""
    k, local = locate(sizes or lengths(*datasets), index)
    return datasets[k].where(F.col("idx") == local).select("size").first()["size"]


def chain(*streams: DataFrame) -> DataFrame:
    """Samples of several sources without an index; batch or streaming."""
    if not streams:
        raise ValueError("datasets should not be empty")
    return reduce(lambda a, b: a.unionByName(b), streams)


class Dataset:
    """A finite table of samples: rows with a dense idx, and an expression of their sizes."""

    def __init__(self, df: DataFrame, idx: str | Column, size: Column | None = None):
        self.rows = df.withColumn("idx", (F.col(idx) if isinstance(idx, str) else idx).cast("long"))
        self.size_expr = size
        self._n: int | None = None

    @property
    def samples(self) -> DataFrame:
        """idx and size."""
        return samples_from(self.rows, "idx", self.size_expr)

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.rows.count()
        return self._n

    def __getitem__(self, index: int):
        _, local = locate([len(self)], index)
        return self.rows.where(F.col("idx") == local).first()

    def size(self, index: int) -> int:
        _, local = locate([len(self)], index)
        return self.samples.where(F.col("idx") == local).first()["size"]

    def __add__(self, other: Dataset) -> ConcatDataset:
        return ConcatDataset(self, other)


class ConcatDataset(Dataset):
    """Datasets one after the other; rows have the columns that all share."""

    def __init__(self, *datasets: Dataset):
        if not datasets:
            raise ValueError("datasets should not be empty")
        self.datasets = datasets
        self.sizes = [len(d) for d in datasets]
        shared = [c for c in datasets[0].rows.columns if c != "idx" and all(c in d.rows.columns for d in datasets)]
        before, parts = 0, []
        for d, n in zip(datasets, self.sizes, strict=True):
            parts.append(d.rows.select((F.col("idx") + before).alias("idx"), *shared))
            before += n
        self.rows, self.size_expr, self._n = reduce(DataFrame.unionByName, parts), None, before

    @property
    def samples(self) -> DataFrame:
        return concat(*(d.samples for d in self.datasets), sizes=self.sizes).select("idx", "size")

    def __getitem__(self, index: int):
        k, local = locate(self.sizes, index)
        return self.datasets[k][local]

    def size(self, index: int) -> int:
        """A lookup in the one dataset that holds the index."""
        k, local = locate(self.sizes, index)
        return self.datasets[k].size(local)


class IterableDataset:
    """Samples without an index or a length, from a batch or a stream."""

    def __init__(self, df: DataFrame):
        self.rows = df

    def __add__(self, other: IterableDataset) -> ChainDataset:
        return ChainDataset(self, other)

    def __iter__(self):
        return self.rows.toLocalIterator(prefetchPartitions=True)


class ChainDataset(IterableDataset):
    """Iterable datasets one after the other; of streams, a stream."""

    def __init__(self, *datasets: IterableDataset):
        super().__init__(chain(*(d.rows for d in datasets)))


def getsizeof(dataset: Dataset, index: int | None = None) -> int:
    """The size of a sample; without an index that of the Python object."""
    return sys.getsizeof(dataset) if index is None else dataset.size(index)
