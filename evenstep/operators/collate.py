"""Batches: a schedule's samples joined to their data and concatenated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstep.functions.dtypes import let

BATCH = ("step", "rank", "micro")
_CONTAINERS = (T.StructType, T.MapType)


def _raise(said: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(said)).cast(kind)


def _rule(kind: T.DataType, name: str) -> Callable[[Column], Column]:
    """How an array of a batch's values of one type becomes one value; raises for types without a rule.

    Arrays are joined one after the other; inner arrays must all be of one length. Structs go
    field by field, maps key by key (of the first value), arrays of structs or maps place by place.
    """
    if isinstance(kind, T.UserDefinedType):
        raise TypeError(f"{name}: sparse vectors are not collated by default; give a rule of your own")
    if isinstance(kind, T.StructType):
        rules = [(f.name, _rule(f.dataType, f"{name}.{f.name}")) for f in kind.fields]
        pick = lambda n: lambda v: v[n]
        return lambda values: F.struct(*(rule(F.transform(values, pick(n))).alias(n) for n, rule in rules))
    if isinstance(kind, T.MapType):
        rule = _rule(kind.valueType, f"{name}[]")
        of_key = lambda values: lambda k: rule(F.transform(values, lambda v: F.coalesce(v[k], _raise(f"{name}: a key of the first sample is missing in another", kind.valueType))))
        return lambda values: let(F.map_keys(F.get(values, F.lit(0))), lambda keys: F.map_from_arrays(keys, F.transform(keys, of_key(values))))
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{name}: no rule to collate {kind.simpleString()}")
    inner = kind.elementType
    if isinstance(inner, _CONTAINERS):
        rule = _rule(inner, f"{name}[]")

        def by_place(values: Column) -> Column:
            sizes = F.transform(values, lambda v: F.size(v))
            each = F.transform(F.get(values, F.lit(0)), lambda _, i: rule(F.transform(values, lambda v: F.get(v, i))))
            return F.when(F.array_min(sizes) == F.array_max(sizes), each).otherwise(_raise(f"{name}: the samples of a batch have lists of unequal length", kind))

        return by_place
    if isinstance(inner, T.ArrayType):

        def rows(values: Column) -> Column:
            widths = F.transform(F.flatten(values), lambda r: F.size(r))
            same = F.coalesce(F.array_min(widths) == F.array_max(widths), F.lit(True))
            return F.when(same, F.flatten(values)).otherwise(_raise(f"{name}: nested arrays of unequal length are not collated by default; give a rule of your own", kind))

        return rows
    return F.flatten


def concatenated(column: str, kind: T.DataType, order: str = "slot") -> Column:
    """An aggregate: a batch's values of a column collated in slot order, by the rules of their type.

    Types without a rule raise TypeError: a sample's fields must be arrays at the innermost level.
    """
    rule = _rule(kind, column)
    rows = F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("x")))
    # maps have no order, so slots are compared on their own
    rows = F.array_sort(rows, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)) if "map<" in kind.simpleString() else F.array_sort(rows)
    return rule(F.transform(rows, lambda r: r["x"]))


def collate(rows: DataFrame, *columns: str, by: tuple[str, ...] = BATCH, order: str = "slot", rules: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """One row per batch with each column concatenated; rules replaces the default for a column.

    A batch is as large as its micro-batch, so what one task gathers does not grow with the data.
    """
    rules = rules or {}
    made = [(rules[c](c) if c in rules else concatenated(c, rows.schema[c].dataType, order)).alias(c) for c in columns]
    return rows.groupBy(*by).agg(*made)


def load(schedule: DataFrame, data: DataFrame, *columns: str, key: str = "idx", rules: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """A schedule's batches of data (one row per idx): one equi-join and one aggregate."""
    return collate(schedule.join(data.select(key, *columns).withColumnRenamed(key, "idx"), "idx"), *columns, rules=rules)


def fixed_batches(positions: DataFrame, batch_size: int = 1, drop_last: bool = False, n: int | None = None) -> DataFrame:
    """positions with batch (pos div batch_size) and slot; drop_last leaves out a short last batch (n rows in all)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    size = F.lit(batch_size).cast("long")
    out = positions.withColumn("batch", F.call_function("div", F.col("pos"), size)).withColumn("slot", F.pmod("pos", size))
    if not drop_last:
        return out
    n = positions.count() if n is None else n
    return out.where(F.col("batch") < n // batch_size)
