"""Partitions and schedules against a second version in SQL."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenstep.operators import schedule as S
from evenstep.operators.groups import balanced_groups
from evenstep.operators.partition import HEURISTICS, partition
from evenstep.operators.sampler import Sampler
from evenstep.operators.schedule import POLICIES, unstable_schedule
from evenstep.plans.balance_sql import partition_ctes, schedule_ctes
from evenstep.plans.diagnostics import spread_mem
from evenstep.plans.queries import GPT3
from tests.test_schedule import CASES, log_uniform, samples


def by_sql(keys, k, heuristic):
    rows = ", ".join(f"({i}, {x})" for i, x in enumerate(keys))
    items = f"items AS (SELECT 0 AS g, CAST({k} AS BIGINT) AS k, CAST(i AS BIGINT) AS ord, CAST(x AS BIGINT) AS key, CAST(i AS BIGINT) AS id FROM (VALUES {rows}) AS t(i, x))"
    return [r[0] for r in duckdb.execute(f"WITH RECURSIVE {items}, {partition_ctes('parts', 'items', heuristic == 'meld')} SELECT ids FROM parts ORDER BY place").fetchall()]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from(["even", "skewed", "ties"]), st.sampled_from(HEURISTICS))
def test_members_of_partitions(k, rounds, seed, kind, heuristic):
    """The very members of every group, in order: odd k, ties, one item a group, few and many blocks."""
    rng = np.random.default_rng(seed)
    n = k * rounds
    keys = {"even": rng.integers(1, 1000, n), "skewed": log_uniform(n, seed), "ties": rng.integers(1, 4, n)}[kind]
    keys = np.sort(keys)
    assert partition(keys, k, heuristic).tolist() == by_sql(keys.tolist(), k, heuristic)


@pytest.mark.parametrize("n, k", [(64, 4), (105, 7), (512, 8)])
def test_melds_happen_and_agree(n, k):
    melds = 0
    for seed in range(6):
        keys = np.sort(log_uniform(n, seed))
        found = {h: partition(keys, k, h).tolist() for h in HEURISTICS}
        melds += found["meld"] != found["bldm"]
        for h in HEURISTICS:
            assert found[h] == by_sql(keys.tolist(), k, h)
    assert melds


@pytest.mark.parametrize("n, ranks, glob, micro, policy, stable", CASES)
def test_assignments(spark, n, ranks, glob, micro, policy, stable):
    """Every sample's step, rank, micro-batch and slot."""
    sampler = Sampler(samples(spark, n), GPT3, ranks, glob, micro, unstable=not stable, policy=policy)
    rows = sampler.positions().collect()
    found = sorted((r.step, r["rank"], r.micro, r.slot, r.pos, r.idx) for r in sampler.schedule().collect())
    values = ", ".join(f"({r.pos}, {r.idx}, {r['size']})" for r in rows)
    sql = schedule_ctes("f", f"size * ({GPT3.c1} + {GPT3.c2} * size)", stable, policy, ranks, glob, micro)
    f = f"f AS (SELECT CAST(a AS BIGINT) AS pos, CAST(b AS BIGINT) AS idx, CAST(c AS BIGINT) AS size FROM (VALUES {values}) AS t(a, b, c))"
    assert found == sorted(duckdb.execute(f"WITH RECURSIVE {f}, {sql} SELECT step, rank, micro, slot, pos, idx FROM s").fetchall())


@pytest.mark.parametrize("policy", POLICIES)
def test_many_batches_are_dealt(spark, policy, monkeypatch):
    """More batches than one task regroups: the same cardinalities, batches in order, and how much less even they are."""
    monkeypatch.setattr(S, "MOST_BATCHES", 16)
    s = Sampler(samples(spark, 4096), GPT3, 4, 64, 4, policy=policy)
    dealt = unstable_schedule(s.positions(), GPT3, s.batching).cache()
    assert sorted(r.idx for r in dealt.collect()) == list(range(4096))
    key = "size" if policy == "mem" else "cost"
    sums = [r.total for r in dealt.groupBy("step", "rank").agg({key: "sum"}).withColumnRenamed(f"sum({key})", "total").orderBy("step", "rank").collect()]
    assert sums == sorted(sums)
    assert all(0 <= r.spread < 0.05 for r in spread_mem(dealt).collect()) or policy == "fast"
    dealt.unpersist()


@pytest.mark.parametrize("k, most", [(8, 10**6), (8, 300), (8, 100), (64, 100), (1, 100), (512, 700)])
def test_groups_of_tables(spark, k, most):
    """One task's groups are the partition's; dealt ones keep cardinalities and order, and stay nearly even."""
    rows = samples(spark, 1024, seed=2)
    found = balanced_groups(rows, k, most_items=most).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.place, []).append((r["size"], r.idx))
    assert sorted(i for own in groups.values() for _, i in own) == list(range(1024))
    assert sorted(groups) == list(range(k)) and {len(own) for own in groups.values()} == {1024 // k}
    sums = [sum(s for s, _ in groups[p]) for p in range(k)]
    assert sums == sorted(sums) and (k > 64 or max(sums) <= 1.2 * min(sums))
    if most > 1024:
        order = sorted((r["size"], r.idx) for r in rows.collect())
        want = partition(np.array([s for s, _ in order]), k)
        assert [sorted(order[i] for i in own) for own in want.tolist()] == [sorted(groups[p]) for p in range(k)]


def test_groups_of_odd_tables(spark):
    assert balanced_groups(samples(spark, 0), 3).collect() == []
    for k in (0, 5):
        with pytest.raises(ValueError):
            balanced_groups(samples(spark, 8), k)
