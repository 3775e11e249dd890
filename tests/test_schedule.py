from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenstep.operators.partition import HEURISTICS, partition, spread
from evenstep.operators.sampler import Sampler, permute, resize, total_size
from evenstep.operators.schedule import POLICIES, Batching, schedule, unstable_schedule
from evenstep.plans.diagnostics import micro_violations, rank_violations, spread_jct, spread_mem
from evenstep.plans.queries import GPT3


def log_uniform(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.round(np.exp(rng.uniform(np.log(0.5), np.log(8192.5), n))).astype(np.int64).clip(1)


@pytest.mark.parametrize("heuristic", HEURISTICS)
@pytest.mark.parametrize("sizes", [np.repeat(np.arange(1, 8193), 8), np.sort(log_uniform(65536))])
def test_large_partitions(sizes, heuristic):
    groups = partition(sizes, 1024, heuristic)
    sums = sizes[groups].sum(1)
    assert groups.shape == (1024, 64) and (np.diff(sums) >= 0).all()
    assert sorted(groups.ravel().tolist()) == list(range(65536))
    assert spread(sums) < 1e-4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=12), st.integers(1, 7), st.sampled_from(HEURISTICS), st.booleans())
def test_partition_properties(block, k, heuristic, down):
    keys = np.sort(np.array(block * k))
    keys = keys[::-1].copy() if down else keys
    groups = partition(keys, k, heuristic)
    assert groups.shape == (k, len(block))
    assert sorted(groups.ravel().tolist()) == list(range(len(keys)))
    assert (np.diff(keys[groups].sum(1)) >= 0).all()


def test_meld_differs_from_bldm():
    found = 0
    for seed in range(20):
        keys = np.sort(log_uniform(64, seed))
        found += not np.array_equal(*(keys[partition(keys, 4, h)].sum(1) for h in HEURISTICS))
    assert found


def test_partition_edges():
    assert partition(np.zeros(0), 0).shape == (0, 0)
    assert partition(np.zeros(0), 5).shape == (5, 0)
    for keys, k in (([1, 2, 3], 2), ([1], 0)):
        with pytest.raises(ValueError):
            partition(np.array(keys), k)
    with pytest.raises(ValueError):
        partition(np.array([1]), 1, "other")


def samples(spark, n, seed=0):
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(log_uniform(n, seed))], "idx long, size long")


CASES = [(1000, 4, 64, 3, p, a) for p in POLICIES for a in (True, False)] + [
    (1024, 4, 64, 4, "joint", False), (103, 3, 24, 16, "mem", True), (103, 3, 24, 16, "joint", False), (40, 1, 16, 5, "fast", False), (6, 2, 64, 4, "mem", False), (6, 2, 64, 4, "joint", True),
]


@pytest.mark.parametrize("n, ranks, glob, micro, policy, stable", CASES)
def test_schedules(spark, n, ranks, glob, micro, policy, stable):
    sampler = Sampler(samples(spark, n), GPT3, ranks, glob, micro, unstable=not stable, policy=policy)
    rows = sampler.schedule().cache()
    found = rows.collect()
    want = sampler.positions().collect()
    assert Counter((r.pos, r.idx, r["size"]) for r in found) == Counter((r.pos, r.idx, r["size"]) for r in want)
    if stable:
        assert all(r.step == r.pos // glob for r in found)
    assert all(v == sampler.total // ranks for v in Counter(r["rank"] for r in found).values())
    for (step, _), count in Counter((r.step, r["rank"]) for r in found).items():
        assert count == min(glob, sampler.total - step * glob) // ranks
    key = "size" if policy == "mem" or policy == "joint" and stable else "cost"
    assert rank_violations(rows, key).first().violations == 0
    assert micro_violations(rows, micro).first().violations == 0
    for (_, _, m), own in group(found, lambda r: (r.step, r["rank"], r.micro)).items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) <= micro
    for _, own in group(found, lambda r: (r.step, r["rank"])).items():
        last = max(r.micro for r in own)
        tail = [r["size"] for r in own if r.micro == last]
        if len(tail) < micro:
            assert min(tail) >= max([r["size"] for r in own if r.micro < last], default=0)
    rows.unpersist()


def group(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def test_unstable_batches_ascend_over_steps(spark):
    rows = Sampler(samples(spark, 1024), GPT3, 4, 64, 4, policy="fast").schedule()
    sums = [r.total for r in rows.groupBy("step", "rank").agg(F.sum("cost").alias("total")).orderBy("step", "rank").collect()]
    assert sums == sorted(sums)


@pytest.mark.parametrize("most", [100, 333])
def test_dealt_parts(spark, most):
    s = Sampler(samples(spark, 1024), GPT3, 4, 64, 4, policy="mem")
    rows = unstable_schedule(s.positions(), GPT3, s.batching, most).cache()
    assert sorted(r.idx for r in rows.collect()) == list(range(1024))
    assert {r.n for r in rows.groupBy("step", "rank").agg(F.count("*").alias("n")).collect()} == {16}
    sums = [r.total for r in rows.groupBy("step", "rank").agg(F.sum("size").alias("total")).orderBy("step", "rank").collect()]
    assert sums == sorted(sums)
    rows.unpersist()


def test_schedules_are_the_same_each_time(spark):
    for stable in (True, False):
        s = Sampler(samples(spark, 500), GPT3, 4, 64, 4, unstable=not stable)
        assert sorted(s.schedule().collect()) == sorted(s.schedule().collect())


def test_bad_arguments(spark):
    positions = permute(samples(spark, 8))
    for args in ((0, 4, 1), (2, 0, 1), (2, 4, 0), (3, 4, 1)):
        with pytest.raises(ValueError):
            Batching(*args)
    with pytest.raises(ValueError):
        Batching(2, 4, 1, "slow")
    with pytest.raises(ValueError):
        schedule(positions, GPT3, Batching(3, 6, 1))
    with pytest.raises(ValueError):
        schedule(positions, GPT3, Batching(2, 4, 1), rank=2)
    with pytest.raises(ValueError):
        schedule(positions.withColumn("size", F.lit(None).cast("long")), GPT3, Batching(2, 4, 1))


def test_empty(spark):
    for stable in (True, False):
        assert Sampler(samples(spark, 0), GPT3, 2, 4, 1, unstable=not stable).schedule().count() == 0


def test_sampler(spark):
    s = samples(spark, 10)
    a, b = permute(s, 3, 4).collect(), permute(s, 5, 2).collect()
    assert sorted(a) == sorted(b) and sorted(r.idx for r in a) == list(range(10)) == sorted(r.pos for r in a)
    assert [r.idx for r in permute(s, shuffle=False).orderBy("pos").collect()] == list(range(10))
    assert (total_size(10, 4), total_size(10, 4, True)) == (12, 8)
    p = permute(s)
    for total in (8, 10, 12, 35):
        by_pos = {r.pos: r.idx for r in p.collect()}
        assert {r.pos: r.idx for r in resize(p, 10, total).collect()} == {i: by_pos[i % 10] for i in range(total)}
    one = Sampler(s, GPT3, 4, 8, 2)
    assert len(one) == 3
    indices = [r.idx for r in one.indices(1).orderBy("place").collect()]
    assert len(indices) == 3
    one.set_epoch(1)
    assert one.positions().orderBy("pos").collect() != permute(s).orderBy("pos").collect()


def test_spreads(spark):
    rows = Sampler(samples(spark, 1024), GPT3, 4, 256, 16, unstable=False).schedule()
    assert all(0 <= r.spread < 0.05 for r in spread_mem(rows).collect())
    assert all(r.spread >= 0 for r in spread_jct(rows).collect())
