"""Documents to packed training sequences in five stages, each written and read again by the next.

Of docs the stages need doc_id and text, the quality stage lang too; further columns, whatever their
names, are kept by all stages but the last. Null text is empty. Rows repeated with one doc_id, and
rows without one, are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstep.llm import block_naming, quality, queries, simhash, toxicity
from evenstep.llm.common import written
from evenstep.packaging import ship

#: Names of helper columns, unlike any of a table's own.
KEPT, SHA = "__evenstep_kept", "__evenstep_sha"


def _one_each(docs: DataFrame, kept: DataFrame, text: Column) -> DataFrame:
    """One row of docs for each row of kept (doc_id, text_sha256: the hash of `text`); a null doc_id counts as a value."""
    same_id = F.col("doc_id").eqNullSafe(F.col(KEPT))
    kept = kept.select(F.col("doc_id").alias(KEPT), F.col("text_sha256").alias(f"{SHA}_kept"))
    out = docs.join(kept.select(KEPT), same_id, "left_semi")
    # only where a doc_id stands in several rows do the texts have to be told apart
    if kept.count() != out.select("doc_id").count():
        out = docs.withColumn(SHA, F.sha2(text, 256)).join(kept, same_id & (F.col(SHA) == F.col(f"{SHA}_kept")), "left_semi").dropDuplicates(["doc_id", SHA]).drop(SHA)
    return out


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a toxicity of 0.7 or more go.

    Null and empty texts stay; repeated rows are judged each, with one verdict; labels of null ids,
    of unknown documents and other than 0 and 1 are not used; without labels all stay.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels")))


def remove_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the base rules or the chosen thresholds reject go.

    Null and empty texts have under 50 words and go; repeated rows are judged each, with one verdict;
    a null lang is a stratum of its own; without enough labels only the base rules reject.
    """
    ship(spark)
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the document with the smallest doc_id stays.

    One row of each text, null and empty ones being one text: a null doc_id only where no row has
    another, and of rows that are tied any one.
    """
    ship(spark)
    found = block_naming.exact_duplicates(docs)
    kept = written(found.where("kept").select("doc_id", "text_sha256"), "kept")
    return _one_each(docs, kept, F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each component of linked fingerprints the document with the smallest doc_id stays.

    Rows of one doc_id, or of none, are told apart by their texts; of rows with one id and one text
    one stays. A null doc_id stays only where no row of the component has another. Texts without words
    have fingerprint zero and are linked like any other.
    """
    ship(spark)
    kept = written(simhash.survivors(docs), "kept")
    return _one_each(docs, kept, F.coalesce("text", F.lit("")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of sequences of at most 2048 tokens, 12 pieces and 2040 tokens that bear loss.

    A null or empty text has the end id only; null doc_ids stay null; repeated rows are packed each.
    """
    ship(spark)
    return queries.packed(docs)


STAGES = [("toxicity", remove_toxic), ("quality", remove_bad), ("exact_dedup", remove_copies), ("near_dedup", remove_near_copies), ("packing", pack)]

#: The scores, thresholds, fingerprints and tokens of the stages are not SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
