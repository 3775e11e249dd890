"""Operator 8: selective reads against whole ones; what a scan really reads."""

import pyarrow.parquet as pq
import pytest

from evenstep.llm import queries, token_files
from evenstep.llm.common import open_shared

WORD = queries.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def files(spark):
    docs = spark.createDataFrame([(3 * i, "a few words " * (1 + i % 7), "x") for i in range(4000)] + [(None, "no key", "y")], "doc_id long, text string, ids string")
    return token_files.write_tokens(docs, WORD, group_tokens=6000, page_rows=32).cache()


@pytest.fixture(scope="module")
def whole(spark, files):
    return {r.doc_id: (r.start, r.n_tokens, r.ids) for r in token_files.read_tokens(spark, files, with_ids=True).collect()}


@pytest.mark.parametrize("first, last", [(None, None), (600, 660), (601, 601), (600, 600), (None, 30), (11_900, None), (-5, -1), (50_000, None)])
def test_ranges(spark, files, whole, first, last):
    found = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in token_files.select_tokens(spark, files, first, last).collect()}
    inside = lambda d: (first is None or d is not None and d >= first) and (last is None or d is not None and d <= last)
    assert found == {d: v for d, v in whole.items() if inside(d)}


def scan_of(df):
    """(rows that the scan gave, its columns) of a query without joins."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scan = next(leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())
    return scan.metrics().get("numOutputRows").get().value(), [f.name() for f in scan.requiredSchema().fields()]


def test_pages_and_columns_are_skipped(spark, files):
    filesystem, name = open_shared(files.orderBy("part").first().file)
    meta = pq.ParquetFile(filesystem.open_input_file(name)).metadata
    group = meta.row_group(0)
    assert meta.num_row_groups > 1 and all(group.column(i).has_offset_index for i in range(4))
    some = token_files.select_tokens(spark, files, 600, 660, ("doc_id", "n_tokens"))
    n, columns = scan_of(some)
    assert some.count() == 21 and columns == ["doc_id", "n_tokens"]
    # 21 documents lie in at most two pages of 32, a row group has many more
    assert 21 <= n <= 64 < group.num_rows
    n, columns = scan_of(token_files.select_tokens(spark, files, 600, 600, ("ids",)))
    assert n <= 32 and columns == ["doc_id", "ids"]


def test_wrong_columns_and_no_files(spark, files):
    with pytest.raises(ValueError):
        token_files.select_tokens(spark, files, columns=("text",))
    assert token_files.select_tokens(spark, files.where("false")).collect() == []


def test_odd_rows(spark):
    """Null and empty texts, repeated rows, null keys, a very long text."""
    docs = spark.createDataFrame([(5, None), (5, None), (5, ""), (None, "b"), (1, "word " * 200_000)], "doc_id long, text string")
    found = token_files.select_tokens(spark, token_files.write_tokens(docs, WORD)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 2), (1, 200_001), (5, 1), (5, 1), (5, 1)]
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 1
        at += r.n_tokens
