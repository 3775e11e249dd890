"""Near copies among labelled documents, which count as one witness.

Texts with the same two least hashes of their shingles, under any of some permutations, are near
copies, and so are their near copies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import written
from evenstep.llm.components import Forest, connected_components
from evenstep.llm.simhash import shingle_hashes

BANDS = 8


def least_hashes(text: str, bands: int = BANDS) -> list[int]:
    """The least hashes of a text's shingles under 2 * bands permutations, as signed numbers."""
    hashes = np.array(shingle_hashes(text) or [0], np.uint64)
    scale = np.random.default_rng(1).integers(1, 1 << 62, (2 * bands, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (hashes * scale).min(1).view(np.int64).tolist()


def copy_groups(hashes: list[list[int]]) -> list[int]:
    """A group's number for each of a bounded list of texts, from least_hashes()."""
    forest, first = Forest(), {}
    for i, least in enumerate(hashes):
        for b in range(0, len(least), 2):
            forest.join(first.setdefault((b, least[b], least[b + 1]), i), i)
    return [forest.root(i) for i in range(len(hashes))]


def witness_groups(rows: DataFrame) -> DataFrame:
    """doc_id and group (the group's smallest doc_id) for rows (doc_id, least: least_hashes()) of
    any number: every band's key links to its smallest doc_id, and links make components."""
    key = lambda i: F.struct(i.alias("band"), F.get("least", i).alias("x"), F.get("least", i + 1).alias("y"))
    keyed = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("least") - 2, F.lit(2)), key)).alias("key")).select("doc_id", "key.*")
    keyed = written(keyed, "witness-bands")
    first = written(keyed.groupBy("band", "x", "y").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "witness-firsts")
    edges = keyed.join(first, ["band", "x", "y"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    roots = connected_components(edges)
    return rows.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group"))
