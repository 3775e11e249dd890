import pytest
from pyspark.sql import functions as F

from evenstep import api
from evenstep.operators.collate import collate, fixed_batches, load
from evenstep.operators.sampler import Sampler
from evenstep.plans.queries import GPT3
from evenstep.sources import datasets, graphs


def test_samples_need_sizes(spark):
    df = spark.createDataFrame([(0, "abc")], "id int, text string")
    assert datasets.samples_from(df, "id", F.length("text")).first() == (0, 3)
    with pytest.raises(NotImplementedError):
        datasets.samples_from(df, "id", None)


def test_concat(spark):
    a = spark.createDataFrame([(0, 5), (1, 6)], "idx long, size long")
    b = spark.createDataFrame([(0, 7)], "idx long, size long")
    rows = sorted(tuple(r) for r in datasets.concat(a, b).collect())
    assert rows == [(0, 5, 0, 0), (1, 6, 0, 1), (2, 7, 1, 0)]
    assert [datasets.size_at([a, b], i) for i in (0, 1, 2, -1, -3)] == [5, 6, 7, 7, 5]
    for i in (3, -4):
        with pytest.raises(ValueError):
            datasets.locate([2, 1], i)
    for f in (datasets.concat, datasets.chain):
        with pytest.raises(ValueError):
            f()
    assert datasets.chain(a, b).count() == 3


def test_collate(spark):
    rows = spark.createDataFrame([(0, 1, [3, 4], ([1],)), (0, 0, [1, 2], ([0],)), (1, 0, [], ([],))], "batch int, slot int, x array<int>, s struct<y:array<int>>")
    found = {r.batch: (r.x, list(r.s.y)) for r in collate(rows, "x", "s", by=("batch",)).collect()}
    assert found == {0: ([1, 2, 3, 4], [0, 1]), 1: ([], [])}
    with pytest.raises(TypeError):
        collate(rows.withColumn("z", F.lit(1)), "z", by=("batch",))
    own = collate(rows, "x", by=("batch",), rules={"x": lambda c: F.sum(F.size(c))})
    assert {r.batch: r.x for r in own.collect()} == {0: 4, 1: 0}


def test_fixed_batches(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    assert fixed_batches(rows, 4).groupBy("batch").count().count() == 3
    assert fixed_batches(rows, 4, drop_last=True).count() == 8
    with pytest.raises(ValueError):
        fixed_batches(rows, 0)


def test_load_keeps_slot_order(spark):
    data = spark.createDataFrame([(i, [i] * (i + 1)) for i in range(12)], "idx long, ids array<int>")
    plan = Sampler(data.select("idx", F.size("ids").cast("long").alias("size")), GPT3, 2, 6, 2, unstable=False).schedule()
    want = {}
    for r in sorted(plan.collect(), key=lambda r: (r.step, r["rank"], r.micro, r.slot)):
        want.setdefault((r.step, r["rank"], r.micro), []).extend([r.idx] * (r.idx + 1))
    assert {(r.step, r["rank"], r.micro): r.ids for r in load(plan, data, "ids").collect()} == want


def numbers(spark, n, first=0):
    df = spark.createDataFrame([(i, [first + i] * (i % 3 + 1)) for i in range(n)], "id long, x array<int>")
    return api.Dataset(df, "id", F.size("x"))


def test_dataset_classes(spark):
    a, b = numbers(spark, 5), numbers(spark, 3, 100)
    both = a + b
    assert isinstance(both, api.ConcatDataset) and len(both) == 8
    assert sorted(tuple(r) for r in both.samples.collect()) == [(i, (i if i < 5 else i - 5) % 3 + 1) for i in range(8)]
    assert both[6].x == [101, 101] and both[-1].x == [102] * 3 and both.size(-1) == api.getsizeof(both, 7) == 3
    assert api.getsizeof(both) > 0
    for i in (8, -9):
        with pytest.raises(ValueError):
            both.size(i)
    with pytest.raises(NotImplementedError):
        api.Dataset(a.rows, "id").samples
    with pytest.raises(ValueError):
        api.ConcatDataset()
    chained = api.IterableDataset(a.rows.select("x")) + api.IterableDataset(b.rows.select("x"))
    assert isinstance(chained, api.ChainDataset) and len(list(chained)) == 8


def test_loader(spark):
    data = numbers(spark, 10)
    loader = api.Loader(data, "x", batch_size=4)
    assert [r.batch for r in loader] == [0, 1, 2] and len(loader) == 3
    assert [r.x for r in loader][2] == [8] * 3 + [9]
    assert len(api.Loader(data, "x", batch_size=4, drop_last=True)) == api.Loader(data, "x", batch_size=4, drop_last=True).batches().count() == 2
    mixed = [r.x for r in api.Loader(data, "x", batch_size=4, shuffle=True)]
    assert sorted(sum(mixed, [])) == sorted(sum(([i] * (i % 3 + 1) for i in range(10)), []))
    sampler = Sampler(data.samples, GPT3, 2, 4, 2)
    order = [r.idx for r in sampler.indices(1).orderBy("place").collect()]
    assert [r.x[0] for r in api.Loader(data, "x", sampler=sampler, rank=1)] == order
    given = spark.createDataFrame([(7, 1, 3), (7, 0, 9), (8, 0, 0)], "batch long, slot long, idx long")
    assert {r.batch: r.x for r in api.Loader(data, "x", batch_sampler=given)} == {7: [9, 3], 8: [0]}
    assert {r.x for r in api.Loader(data, "x", batch_size=5, rules={"x": lambda c: F.sum(F.size(c))})} == {9, 10}
    for wrong in ({"batch_size": 0}, {"sampler": sampler, "shuffle": True}, {"batch_sampler": given, "batch_size": 2}):
        with pytest.raises(ValueError):
            api.Loader(data, "x", **wrong)


def test_graph_files(spark, tmp_path):
    graphs.save(graphs.graph_nodes(spark, "gpt3"), f"{tmp_path}/g")
    assert graphs.load(spark, f"{tmp_path}/g").count() == len(graphs.trace("gpt3").rows())
    spark.range(3).write.parquet(f"{tmp_path}/h")
    with pytest.raises(ValueError):
        graphs.load(spark, f"{tmp_path}/h")
