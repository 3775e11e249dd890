"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints/evenstep"

_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may lack the setting; it then gets a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL_DEFAULT}"


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder. The application's folder goes when the driver's JVM
    ends, whether or not the session was stopped before; clear() removes it earlier."""
    root = f"{shared_dir(spark)}/evenstep-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        files, path = _files(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; frames that read them can't be used any more."""
    root = f"{shared_dir(spark)}/evenstep-{spark.sparkContext.applicationId}"
    files, path = _files(spark, root)
    files.delete(path, True)
    _ROOTS.discard(root)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with each row's place (0, 1, ...) in the order of the given columns.

    A range partition and a sort within partitions, written once; then each partition's rows are
    shifted by the rows before it. What goes to the driver is a count for each partition. The
    order should be total; equal rows get places in any order.
    """
    cells = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__cell", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__cell", 33).cast("int")
    counts = sorted((r.part, r.n) for r in cells.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    shifts, before = [], 0
    for p, n in counts:
        shifts.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(shifts, "__part int, __shift long")
    local = F.col("__cell").bitwiseAND(F.lit((1 << 33) - 1))
    out = cells.withColumn("__part", part).join(F.broadcast(table), "__part")  # one row per partition
    return out.withColumn(name, local + F.col("__shift")).drop("__cell", "__part", "__shift")
