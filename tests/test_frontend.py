"""Samplers, loaders, collating, ingestion, graphs as bytes, storage and logs."""

import logging
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenstep import api, storage
from evenstep.functions.cost import node_costs, transform
from evenstep.functions.polynomial import Polynomial
from evenstep.operators.collate import collate
from evenstep.operators.sampler import Sampler
from evenstep.plans.queries import GPT3, raw_graph
from evenstep.sources import graphs, ingest
from tests.test_datasets import numbers


def test_sampler_from_dataset_and_graph(spark):
    data, graph = numbers(spark, 21), graphs.graph_nodes(spark, "gpt3")
    sampler = Sampler(data, graph, 4, 8, 2, tensor_parallel=4, context_parallel=1, rank=2)
    assert sampler.cost == Polynomial(0, 39372164, 1315).with_tensor_parallel(4) and len(sampler) == 6
    own = list(sampler)
    assert own == [r.idx for r in sampler.indices(2).orderBy("place").collect()]
    every = [i for r in range(4) for i in Sampler(data, graph, 4, 8, 2, tensor_parallel=4, rank=r)]
    assert len(every) == 24 and set(every) == set(range(21))
    sampler.set_epoch(3)
    assert list(sampler) != own
    for wrong in ({"rank": 4}, {"rank": -1}):
        with pytest.raises(ValueError):
            Sampler(data, graph, 4, 8, 2, **wrong)
    with pytest.raises(ValueError):
        Sampler(data, GPT3, 4, 8, 2, tensor_parallel=2)
    with pytest.raises(ValueError):
        list(Sampler(data, GPT3, 4, 8, 2))


def test_log_has_micro_batches(spark, caplog):
    with caplog.at_level(logging.INFO, "evenstep.operators.schedule"):
        list(Sampler(numbers(spark, 22), GPT3, 2, 8, 3, rank=0))
    assert any("Reordering 8 micro-batches took" in m for m in caplog.messages)


def test_log_of_costing(spark, caplog):
    with caplog.at_level(logging.INFO, "evenstep.functions.cost"):
        transform(graphs.graph_nodes(spark, "gpt3"))
    n = len(graphs.trace("gpt3").rows())
    assert any(f"Costing a graph of {n} nodes took" in m for m in caplog.messages)


def test_loader_options(spark):
    data = numbers(spark, 10)
    loader = api.Loader(data, "x", batch_size=4, num_workers=2, prefetch_factor=3, persistent_workers=True, in_order=False)
    assert sorted(r.batch for r in loader) == [0, 1, 2]
    assert [r.x for r in api.Loader(data, "x", batch_size=None)] == [[i] * (i % 3 + 1) for i in range(10)]
    own = api.Loader(data, "x", batch_size=5, collate_fn=lambda rows: rows.groupBy("batch").agg(F.sum(F.size("x")).alias("n")))
    assert [r.n for r in own] == [9, 10]

    class Generator:
        def initial_seed(self):
            return 3

    orders = [[r.x for r in api.Loader(data, "x", batch_size=2, shuffle=True, **o)] for o in ({"seed": 3}, {"generator": 3}, {"generator": Generator()}, {"seed": 4})]
    assert orders[0] == orders[1] == orders[2] != orders[3]
    sampler = Sampler(data, GPT3, 2, 4, 2, rank=1)
    assert [r.x[0] for r in api.Loader(data, "x", sampler=sampler)] == list(sampler)
    for wrong in ({"num_workers": -1}, {"timeout": -1}, {"prefetch_factor": 2}, {"persistent_workers": True}, {"batch_size": None, "drop_last": True}, {"collate_fn": len, "rules": {"x": F.count}}):
        with pytest.raises(ValueError):
            api.Loader(data, "x", **wrong)
    for name in ("timeout", "worker_init_fn", "multiprocessing_context", "pin_memory", "pin_memory_device"):
        with pytest.raises(NotImplementedError, match=name):
            api.Loader(data, "x", **{name: 1})


def test_collate_nested(spark):
    kind = "batch int, slot int, v struct<a:array<array<int>>,m:map<string,array<int>>,l:array<struct<y:array<int>>>>"
    one = lambda b, s, i: (b, s, ([[i, i], [i + 1, i]], {"k": [i], "j": []}, [([i],), ([-i],)]))
    rows = spark.createDataFrame([one(0, 1, 5), one(0, 0, 4), one(1, 0, 7)], kind)
    found = {r.batch: r.v for r in collate(rows, "v", by=("batch",)).collect()}
    assert found[0].a == [[4, 4], [5, 4], [5, 5], [6, 5]] and found[0].m == {"k": [4, 5], "j": []}
    assert [x.y for x in found[0]["l"]] == [[4, 5], [-4, -5]] and found[1].a == [[7, 7], [8, 7]]

    def fails(said, *values):
        with pytest.raises(Exception, match=said):
            collate(spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], kind), "v", by=("batch",)).collect()

    fails("nested arrays of unequal length", ([[1, 2], [3]], {}, []))
    fails("missing", ([], {"k": [1]}, []), ([], {"j": [1]}, []))
    fails("lists of unequal length", ([], {}, [([1],)]), ([], {}, []))
    for bad, said in ((F.lit("text"), "no rule"), (F.struct(F.lit(1).alias("n")), "no rule"), (F.array(F.struct(F.lit(1).alias("n"))), "no rule")):
        with pytest.raises(TypeError, match=said):
            collate(rows.withColumn("z", bad), "z", by=("batch",))
    sparse = spark.createDataFrame([(0, 0, Vectors.sparse(3, [1], [1.0]))], ["batch", "slot", "z"])
    with pytest.raises(TypeError, match="sparse"):
        collate(sparse, "z", by=("batch",))


DIMENSIONS = {"128": (128, 0), "s0": (0, 1), "2*s0 + 1": (1, 2), "s0 - 3": (-3, 1), "-s0+s0*4-7": (-7, 3), "s0**2 + s0": (0, 1), "3*s0**2": (0, 0), "+5": (5, 0), "- 2": (-2, 0), "2*s12*1 ": None}


def test_dimensions(spark):
    good = {t: d for t, d in DIMENSIONS.items() if d}
    rows = spark.createDataFrame([(t,) for t in good], "t string").select("t", ingest.dimension(F.col("t")).alias("d")).collect()
    assert {r.t: tuple(r.d) for r in rows} == good
    for bad in ("s0*s1", "s0+s1", "s0//2", "", "x y", "1 2", "(s0+1)*2", "2.5", "2*s12*1", None):
        with pytest.raises(Exception, match="Unknown dimension"):
            spark.createDataFrame([(bad,)], "t string").select(ingest.dimension(F.col("t"))).collect()


def test_arguments_that_are_no_tensors_go(spark):
    nodes = ingest.parsed(raw_graph(spark)).collect()
    assert [len(r.args) for r in nodes] == [0, 2, 1, 1, 1] and nodes[0].meta is None


def test_graph_bytes(spark):
    graph = graphs.graph_nodes(spark, "qwen3")
    data = graphs.to_bytes(graph)
    assert sorted(graphs.from_bytes(spark, data).collect()) == sorted(graph.collect())
    assert graphs.from_bytes(spark, graphs.to_bytes(graph.where("false"))).count() == 0
    for bad in (b"", b"no graph", data[: len(data) // 2], data[100:]):
        with pytest.raises(ValueError):
            graphs.from_bytes(spark, bad)


def test_plans_of_costs_are_short(spark):
    plan = node_costs(graphs.graph_nodes(spark, "gpt3"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 50_000


def test_tables_go_with_the_driver(tmp_path):
    """Also when the session is stopped before the program ends."""
    code = """
from pyspark.sql import SparkSession
from evenstep import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://%s").getOrCreate()
storage.written(spark.range(3), "x")
assert any(d.startswith("evenstep-") for d in __import__("os").listdir("%s"))
spark.stop()
"""
    root = Path(storage.__file__).parents[1]
    subprocess.run([sys.executable, "-c", code % (tmp_path, tmp_path)], check=True, env=os.environ | {"PYTHONPATH": str(root)}, timeout=120)
    left = lambda: [d for d in os.listdir(tmp_path) if d.startswith("evenstep-")]  # noqa: E731  (Spark has a folder of its own there)
    for _ in range(50):
        if not left():
            break
        time.sleep(0.2)
    assert not left()


