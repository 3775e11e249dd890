"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstep.storage import shared_dir, work_path, written

__all__ = ["doc_texts", "one_each", "open_shared", "per_batch", "shared_dir", "small_batches", "work_path", "written"]

def open_shared(path: str):
    """(file system, path in it) of a path below the shared folder, usable on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def one_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list of rows, such as files, with a task for each."""
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__task int, {schema}")
    return (numbered.repartitionById(len(rows), "__task") if rows else numbered).drop("__task")


def doc_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only key and text, null text as empty: clashing names of further columns can't matter."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes of text, so that Python objects stay bounded."""
    yield from _slices(batches, column, most_bytes)
    give_back()


def _slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = have = 0
        for i, n in enumerate(sizes):
            if have and have + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, have = i, 0
            have += n or 0
        yield batch.slice(start)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """df with f applied to slices of its rows, without a shuffle."""

    def run(batches):
        for batch in small_batches(batches, column):
            out = f(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
