"""Operator 4: payload groups that are too many to broadcast, odd rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenstep.llm import warc


@pytest.mark.parametrize("most, bits", [(10**6, 64), (0, 1 << 17), (0, 64), (0, 1)])
def test_origins(spark, most, bits):
    """By broadcast, by a map with hardly a wrong place, and by maps that are full."""
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.sha2(F.concat(F.lit("x"), (F.col("id") % 150).cast("string")), 256).alias("h")).withColumn("sha256", F.unhex("h")).drop("h")
    groups = rows.where("page_id % 150 < 40").groupBy("sha256").agg(F.max("page_id").alias("origin")).cache()
    found = Counter(map(tuple, warc.with_origins(rows, groups, most, bits).select("page_id", "origin").collect()))
    last = {i % 150: i for i in range(400)}
    assert found == Counter((i, last[i % 150] if i % 150 < 40 else None) for i in range(400))


@pytest.mark.parametrize("most", [100_000, 0])
def test_odd_pages(spark, most):
    """Null, empty and very long payloads, ties, repeated rows, null keys, clashing names, no rows."""
    big = "é" * 3_000_000
    made = [(1, None), (2, ""), (3, big), (4, big), (4, big), (None, big), (5, "s" * 999), (6, "s" * 999), (7, "t" * 1000), (None, None)]
    pages = spark.createDataFrame([(i, None, h, b"0", 1, True) for i, h in made], "page_id long, url string, html string, sha256 binary, origin int, hit boolean").repartition(2)
    found = Counter(map(tuple, warc.read_archives(spark, warc.write_archives(pages, most_groups=most, map_bits=1 << 16)).collect()))
    want = Counter()
    for p, html in made:
        data = (html or "").encode()
        revisit = data == big.encode() and p != 4
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None] += 1
    assert found == want
    assert not warc.read_archives(spark, warc.write_archives(pages.where("false"), most_groups=most)).collect()
