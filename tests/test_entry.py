import functools
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from evenstep.plans import queries as plans
from evenstep.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def schedules_are_made_once():
    """Many queries look at the same six schedules."""
    made = plans._scheduled
    plans._scheduled = functools.lru_cache(None)(lambda *args: made(*args).cache())
    yield
    plans._scheduled = made


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else int(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf, con):
    got = QUERIES[name](spark, sf)
    order = sorted(got.columns)
    found = sorted((plain([r[c] for c in order]) for r in got.collect()), key=repr)
    want = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == order
    assert found == sorted((plain([r[at[c]] for c in order]) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("n", [1, 65, 501, 1002])
def test_load_batches_of_any_count(n, spark, sf, tmp_path):
    """Counts that are no multiple of the ranks: the samples that fill them up are no new numbers."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE embeddings AS SELECT * REPLACE (vec_id + 500 * r AS vec_id) FROM '{sf}/embeddings.parquet', range(3) AS t(r) WHERE vec_id + 500 * r < {n}")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    got = QUERIES["load_batches"](spark, str(tmp_path)).select("numbers", "batches").collect()
    assert [tuple(r) for r in got] == con.execute(ORACLES["load_batches"]).fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import subprocess

    code = "import sys, bench, evenstep.plans.queries; assert not any(m.startswith('evenstep.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
