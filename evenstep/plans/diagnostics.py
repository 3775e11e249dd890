"""How even a schedule is, and what must hold of every schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(total: str) -> Column:
    return ((F.max(total) - F.min(total)) / F.min(total)).alias("spread")


def spread_mem(schedule: DataFrame) -> DataFrame:
    """step and spread: (largest - smallest) / smallest sum of sizes over the ranks' batches."""
    return schedule.groupBy("step", "rank").agg(F.sum("size").alias("total")).groupBy("step").agg(_ratio("total"))


def spread_jct(schedule: DataFrame) -> DataFrame:
    """step, micro and spread of the sums of costs over the ranks."""
    return schedule.groupBy("step", "micro", "rank").agg(F.sum("cost").alias("total")).groupBy("step", "micro").agg(_ratio("total"))


def cardinalities(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("step", "rank", "micro").agg(F.count(F.lit(1)).alias("n"))


def step_totals(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("total"))


def _falls(sums: DataFrame, inner: str, *outer: str) -> DataFrame:
    """Number of places where `total` is larger than at the next `inner`, by a join on neighbours."""
    following = sums.select(*outer, (F.col(inner) - 1).alias(inner), F.col("total").alias("next"))
    return sums.join(following, [*outer, inner]).where("total > next").agg(F.count(F.lit(1)).alias("violations"))


def rank_violations(schedule: DataFrame, key: str) -> DataFrame:
    """Neighbouring ranks of a step whose sums of key don't ascend."""
    return _falls(schedule.groupBy("step", "rank").agg(F.sum(key).alias("total")), "rank", "step")


def micro_violations(schedule: DataFrame, micro_batch: int) -> DataFrame:
    """Neighbouring full micro-batches of a rank's step whose costs don't ascend."""
    sums = schedule.groupBy("step", "rank", "micro").agg(F.sum("cost").alias("total"), F.count(F.lit(1)).alias("n"))
    return _falls(sums.where(F.col("n") == micro_batch).drop("n"), "micro", "step", "rank")
