"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. Equal blocks get one integer name: the distinct blocks
are sorted and numbered. Then adjacent pairs of names are sorted and numbered in the same way,
again and again, until each text has one name. Names are equal if and only if texts are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import doc_texts, per_batch, written

BLOCK = 2048
_SPACES = re.compile(rb"[ \t-\r]+")


def normalised(text: str) -> bytes:
    """UTF-8 of text with each run of ASCII white space as one space."""
    return _SPACES.sub(b" ", text.encode("utf-8", "surrogatepass"))


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _handle(block: bytes) -> bytes:
    """128 bits to find a block's name by. Names go by content; that no two blocks share a handle is checked."""
    return xxhash.xxh3_128_digest(block)


def numbered(df: DataFrame, order: list[str], tag: str, without: str | None = None) -> DataFrame:
    """df, sorted within its partitions, with a column `name`: partition and place, never equal twice."""
    kept = [f for f in df.schema if f.name != without]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept)}, name long"

    def run(batches):
        name = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(np.arange(name, name + batch.num_rows))], [*batch.schema.names, "name"])
                name += batch.num_rows

    return written(df.sortWithinPartitions(*order).select([f.name for f in kept]).mapInArrow(run, schema), tag)


def name_documents(docs: DataFrame, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, text_sha256 and identity, equal for equal normalised texts.

    Also rid, which tells repeated rows apart, and n_bytes. Null text counts as empty; null keys are kept; further columns
    are ignored; an empty table gives no rows. Texts of any length take log2(length / block)
    rounds. A text with a block that no other text has is done after the first: it can have no
    equal, and that block's name is its identity.
    """
    texts = doc_texts(docs, text, key)

    def keyed(batch):
        rows = [normalised(t) for t in batch.column(1).to_pylist()]
        handles = [[_handle(b) for b in _blocks(r, block)] for r in rows]
        return pa.record_batch([batch.column(0), pa.array([hashlib.sha256(r).hexdigest() for r in rows]), pa.array(map(len, rows), pa.int64()), pa.array(handles, pa.list_(pa.binary()))], ["doc_id", "text_sha256", "n_bytes", "handles"])

    # rid is fixed by this write; nothing below reads the input's order again
    rows = written(per_batch(texts, keyed, "doc_id long, text_sha256 string, n_bytes long, handles array<binary>").withColumn("rid", F.monotonically_increasing_id()), "keyed")

    def cut(batch):
        seen = {b for t in batch.column(1).to_pylist() for b in _blocks(normalised(t), block)}
        order = sorted(seen)
        return pa.record_batch([pa.array([_handle(b) for b in order], pa.binary()), pa.array(order, pa.binary())], ["handle", "block"])

    # equal blocks of a task's slices are one row already; then one row per block and task
    blocks = per_batch(texts, cut, "handle binary, block binary").groupBy("handle", "block").agg(F.lit(1).alias("one"))
    names = numbered(blocks.select("handle", "block"), ["block"], "blocks", "block")
    if not names.groupBy("handle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("two blocks share a handle; choose another block size")
    places = rows.select("rid", F.posexplode("handles").alias("pos", "handle"))
    uses = places.groupBy("handle").agg(F.count(F.lit(1)).alias("uses"))
    # written, as are the groups below: Spark can split a hot key where both sides of a join are tables
    named = places.join(written(names.join(uses, "handle"), "block-uses"), "handle")
    lists = named.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("at"), F.min("uses").alias("uses"), F.min_by("name", F.struct("uses", "pos")).alias("first"))
    lists = written(lists.select("rid", "uses", "first", F.transform("at", lambda x: x["name"]).alias("names")), "names-0")
    alone = lists.where("uses = 1").select("rid", F.concat(F.lit("b"), F.col("first").cast("string")).alias("identity"))
    left = lists.where("uses > 1").select("rid", "names")
    longest = left.agg(F.max(F.size("names")).alias("n")).first().n or 1
    level = 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        pairs = left.select("rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("(size(names) - 1) div 2")), lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias("pos", "pair")).select("rid", "pos", "pair.a", "pair.b")
        names = numbered(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), ["a", "b"], f"pairs-{level}")
        left = pairs.join(names, ["a", "b"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("at"))
        left = written(left.select("rid", F.transform("at", lambda x: x["name"]).alias("names")), f"names-{level}")
    settled = alone.unionByName(left.select("rid", F.concat(F.lit("t"), F.get("names", F.lit(0)).cast("string")).alias("identity")))
    return rows.select("rid", "doc_id", "text_sha256", "n_bytes").join(settled, "rid")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays (a null key only if all are null; of
    rows repeated with one key, one). Edge cases are those of name_documents().
    """
    named = written(name_documents(docs, block, text, key), "identities")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    groups = named.where("identity like 't%'").groupBy("identity").agg(F.count(F.lit(1)).alias("group_size"), least)
    groups = written(groups.select("identity", "group_size", F.col("least.doc_id").alias("least_id"), F.col("least.rid").alias("least_rid")), "groups")
    many = named.where("identity like 't%'").join(groups, "identity").select("doc_id", F.col("least_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least_rid")).alias("kept"), "text_sha256")
    one = named.where("identity like 'b%'").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return one.unionByName(many)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
