"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from evenstep.operators.sampler import Sampler
    from evenstep.packaging import ship
    from evenstep.plans import diagnostics as D
    from evenstep.sources import datasets, graphs
    from evenstep.functions.cost import transform
    from evenstep.storage import with_position, written

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    lines = written(with_position(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size", name="idx").select("idx", "size"), "bench-samples")
    documents = datasets.samples_from(read("documents"), "doc_id", F.col("n_chars"))
    times, evenness = {}, {}

    def timed(name, run):
        spent = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.perf_counter()
            out = run()
            spent.append(time.perf_counter() - began)
        times[name] = round(min(spent), 3)
        return out

    timed("transform_gpt3", lambda: transform(graphs.graph_nodes(spark, "gpt3"), 4))
    for table, samples in (("lineitem", lines), ("documents", documents)):
        for stable in (True, False):
            for policy in ("fast", "mem", "joint"):
                name = f"{'stable' if stable else 'unstable'}_{policy}_{table}"
                make = lambda t=samples, u=not stable, p=policy: Sampler(t, graphs.graph_nodes(spark, "gpt3"), 4, 256, 16, unstable=u, policy=p, tensor_parallel=4)
                found = timed(name, lambda m=make: D.spread_mem(m().schedule()).agg(F.avg("spread")).first()[0])
                evenness[name] = round(found, 6)
    try:
        from evenstep.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, query in QUERIES.items():
        timed(name, lambda q=query: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "spread_mem": evenness, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
