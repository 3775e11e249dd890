"""Token ids in Parquet list columns with chosen encoding, row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstep.llm.bpe import word_encoder
from evenstep.llm.common import doc_texts, one_each, open_shared, small_batches, work_path, written

END_ID = 1
FILE_SCHEMA = pa.schema([pa.field("doc_id", pa.int64()), pa.field("local_start", pa.int64()), pa.field("ids", pa.list_(pa.field("element", pa.int32(), nullable=False))), pa.field("n_tokens", pa.int64())])
FILES = "file string, part int, tokens long, rows long, first_id long, last_id long"


def writer(path, filesystem, encoding: str = "dictionary", page_bytes: int = 256 << 10, page_rows: int = 512) -> pq.ParquetWriter:
    """A writer of the file format. encoding: 'dictionary', or 'delta' (DELTA_BINARY_PACKED).

    Pages end after page_bytes or page_rows documents, so that the page index tells few of them
    apart also in columns of small numbers.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    delta = dict.fromkeys(("doc_id", "local_start", "n_tokens"), "DELTA_BINARY_PACKED")
    if encoding == "delta":
        delta["ids.list.element"] = "DELTA_BINARY_PACKED"
    return pq.ParquetWriter(
        path, FILE_SCHEMA, filesystem=filesystem, compression="zstd", compression_level=1, data_page_size=page_bytes,
        use_dictionary=["ids.list.element"] if encoding == "dictionary" else False, column_encoding=delta, write_page_index=True, max_rows_per_page=page_rows,
    )


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id", encoding: str = "dictionary", group_tokens: int = 4 << 20, page_rows: int = 512) -> DataFrame:
    """Writes ids (end_id after each document) in ascending key order; returns the files.

    One file per range of keys (FILES): part is its position in key order, first_id and last_id
    are its least and largest key (null if all are); only files that a finished task wrote; what lost attempts left is not listed. Null text is empty and
    has only end_id; null keys come first; rows of one key stand by their text's hash; an empty table
    gives no files. Row groups close after group_tokens ids. Rows stream through a task, one
    row group in memory at a time.
    """
    spark = docs.sparkSession
    folder = work_path(spark, "tokens")
    rows = doc_texts(docs, text, key).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        filesystem, root = open_shared(folder)
        part, out, name, held, group, tokens, n = TaskContext.get().partitionId(), None, "", 0, [], 0, 0
        first = last = None
        encoder = word_encoder(path, False)

        def flush():
            out.write_table(pa.Table.from_batches(group), row_group_size=1 << 30)
            group.clear()

        for batch in small_batches(batches):
            if out is None:
                filesystem.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
                out = writer(f"{root}/{name}", filesystem, encoding, page_rows=page_rows)
            ids, bounds = encoder.encode_batch(batch.column(1).to_pylist(), end_id)
            values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))).cast(FILE_SCHEMA.field("ids").type)
            made = pa.record_batch([batch.column(0), pa.array(bounds[:-1] + tokens), values, pa.array(np.diff(bounds).astype(np.int64))], schema=FILE_SCHEMA)
            keys = batch.column(0).drop_null()
            if len(keys):
                first, last = keys[0].as_py() if first is None else first, keys[-1].as_py()
            at = 0
            while at < made.num_rows:  # up to the document that fills the row group
                end = min(int(np.searchsorted(bounds, bounds[at] + group_tokens - held)), made.num_rows)
                group.append(made.slice(at, end - at))
                held += int(bounds[end] - bounds[at])
                at = end
                if held >= group_tokens:
                    flush()
                    held = 0
            tokens, n = tokens + int(bounds[-1]), n + batch.num_rows
        if out is not None:
            if group:
                flush()
            out.close()
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array([x], k) for x, k in zip((f"{folder}/{name}", part, tokens, n, first, last), kinds, strict=True)], [c.split()[0] for c in FILES.split(", ")])

    return written(rows.mapInArrow(run, FILES), "token-files")


def _with_bases(files: DataFrame) -> list[tuple]:
    """Rows of FILES in key order, each with the ids of all files before it: one short row for each range partition."""
    base, out = 0, []
    for r in files.orderBy("part").collect():
        out.append((r, base))
        base += r.tokens
    return out


def select_tokens(spark: SparkSession, files: DataFrame, first: int | None = None, last: int | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents with first <= doc_id <= last (None: no bound) and only the asked columns.

    A scan with pushed filters: files are left out by their keys, row groups by their
    statistics, pages by the page index, and columns that are not asked for (such as ids) are not
    read. Null keys are in a result without bounds only. No rows: an empty result.
    """
    if wrong := set(columns) - {"doc_id", "start", "n_tokens", "ids"}:
        raise ValueError(f"no such columns: {sorted(wrong)}")
    bounded = first is not None or last is not None
    outside = lambda r: bounded and (r.first_id is None or (first is not None and r.last_id < first) or (last is not None and r.first_id > last))
    plan = [(r.file, base) for r, base in _with_bases(files) if not outside(r)]
    schema = "doc_id long, local_start long, ids array<int>, n_tokens long"
    rows = spark.read.schema(schema).parquet(*(f for f, _ in plan)) if plan else spark.createDataFrame([], schema)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    if "start" in columns:
        if plan:
            bases = spark.createDataFrame([(f.rpartition("/")[2], b) for f, b in plan], "name string, base long")
            rows = rows.withColumn("name", F.col("_metadata.file_name")).join(F.broadcast(bases), "name")  # one row a file
        else:
            rows = rows.withColumn("base", F.lit(0))
        rows = rows.withColumn("start", F.col("local_start") + F.col("base"))
    return rows.select(*columns)


def read_tokens(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the listed files: doc_id, start (ids before it in key order), n_tokens, ids_crc32, and ids if asked.

    The list of files goes to the driver: one short row for each range partition.
    """
    plan = [(r.file, base) for r, base in _with_bases(files)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    todo = one_each(spark, plan, "file string, base long")

    def run(batches):
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                filesystem, name = open_shared(file)
                with pq.ParquetFile(filesystem.open_input_file(name)) as f:
                    for k in range(f.num_row_groups):
                        for rows in f.iter_batches(4096, row_groups=[k], columns=["doc_id", "local_start", "ids"]):
                            ids = rows.column(2)
                            bounds = ids.offsets.to_numpy()
                            raw = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
                            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                            out = [rows.column(0), pa.array(rows.column(1).to_numpy() + first), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())]
                            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                            if with_ids:
                                out.append(pa.ListArray.from_arrays(ids.offsets, ids.values))
                                names.append("ids")
                            yield pa.record_batch(out, names)

    return todo.mapInArrow(run, schema)
