"""Costs of tensor operators as polynomials of the sample size.

A registry maps an operator's name to a rule: a function from the node's arguments and output
(columns) to a polynomial column. All rules stand in one CASE over the node table, so that costs
are one projection and a model's cost is one aggregate.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstep.functions.dtypes import promoted, scale_of
from evenstep.functions.polynomial import Polynomial, add, multiply, poly

log = logging.getLogger(__name__)

TENSOR = "struct<dtype:string,shape:array<struct<c0:bigint,c1:bigint>>>"
NODES = f"model string, node_id int, target string, args array<{TENSOR}>, meta {TENSOR}"

Rule = Callable[[Column, Column], Column]

# Operators whose cost is a number of operations on each element of the first argument.
PER_INPUT = {
    "_SOFTMAX": 5, "CUMSUM": 1, "GELU": 14, "MEAN_DIM": 1, "MUL_SCALAR": 1, "NEG": 1, "POW_TENSOR_SCALAR": 1,
    "RELU": 1, "RSQRT": 1, "RSUB_SCALAR": 2, "SILU": 4, "TANH": 6,
}
# Operators without a cost: views, copies, creation, comparison.
FREE = (
    "_TO_COPY", "_UNSAFE_VIEW", "ALIAS", "ALL_DIM", "ARANGE", "ARANGE_START", "BITWISE_NOT", "CAT", "CLONE", "COPY",
    "EMBEDDING", "EQ_SCALAR", "EXPAND", "FULL", "GT_TENSOR", "LT_TENSOR", "MASKED_FILL_SCALAR", "ONES", "ONES_LIKE",
    "PERMUTE", "SCALAR_TENSOR", "SLICE_TENSOR", "SLICE_SCATTER", "SPLIT_TENSOR", "T", "TRANSPOSE_INT", "TRIL", "TRIU",
    "UNSQUEEZE", "VIEW", "WHERE_SELF",
)


def volume(shape: Column, times: Column | int = 1) -> Column:
    """The product of a shape's dimensions and `times`; `times` for a scalar."""
    return F.aggregate(shape, poly(times), lambda p, d: multiply(p, poly(d["c0"], d["c1"], 0)))


def total(*parts: Column) -> Column:
    """The sum of polynomials, each of which the plan holds once."""
    return F.aggregate(F.array(*parts), poly(), add)


def _checked(ok: Column, said: str, value: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(said)).cast("struct<c0:bigint,c1:bigint,c2:bigint>"))


def _arg(args: Column, i: int) -> Column:
    return F.get(args, F.lit(i))


def _type(args: Column, i: int) -> Column:
    return _arg(args, i)["dtype"]


def _at(args: Column, i: int, k: int) -> Column:
    return F.get(_arg(args, i)["shape"], F.lit(k))


def _rank(args: Column, i: int) -> Column:
    return F.size(_arg(args, i)["shape"])


@cache
def per_input(factor: int) -> Rule:
    def rule(args: Column, meta: Column) -> Column:
        return _checked(F.size(args) == 1, "One argument is expected", volume(_arg(args, 0)["shape"], scale_of(_type(args, 0)) * factor))

    return rule


@cache
def per_output(by_arguments: bool) -> Rule:
    """Operations on each element of the output, at the arguments' common type; by_arguments: one for each argument."""

    def rule(args: Column, meta: Column) -> Column:
        n = F.size(args)
        common = F.when(n > 1, promoted(_type(args, 0), _type(args, 1))).otherwise(_type(args, 0))
        factor = scale_of(common) * (n.cast("bigint") if by_arguments else F.lit(1))
        return _checked(n >= 1, "An argument is expected", volume(meta["shape"], factor))

    return rule


def free(args: Column, meta: Column) -> Column:
    return poly()


def mm(args: Column, meta: Column) -> Column:
    ok = (F.size(args) == 2) & (_rank(args, 0) == 2) & (_rank(args, 1) == 2) & (_at(args, 0, 1) == _at(args, 1, 0))
    sizes = F.array(_at(args, 0, 0), _at(args, 0, 1), _at(args, 1, 1))
    return _checked(ok, "mm expects matrices that fit", volume(sizes, scale_of(promoted(_type(args, 0), _type(args, 1)))))


def bmm(args: Column, meta: Column) -> Column:
    ok = (F.size(args) == 2) & (_rank(args, 0) == 3) & (_rank(args, 1) == 3) & (_at(args, 0, 0) == _at(args, 1, 0)) & (_at(args, 0, 2) == _at(args, 1, 1))
    sizes = F.array(_at(args, 0, 0), _at(args, 0, 1), _at(args, 0, 2), _at(args, 1, 2))
    return _checked(ok, "bmm expects batches of matrices that fit", volume(sizes, scale_of(promoted(_type(args, 0), _type(args, 1)))))


def addmm(args: Column, meta: Column) -> Column:
    """The product at the matrices' type, and two scalings and a sum at the type of all three."""
    ok = (F.size(args) == 3) & (_rank(args, 1) == 2) & (_rank(args, 2) == 2) & (_at(args, 1, 1) == _at(args, 2, 0))
    inner = promoted(_type(args, 1), _type(args, 2))
    outer = promoted(inner, _type(args, 0))
    rows, columns = _at(args, 1, 0), _at(args, 2, 1)
    product, rest = volume(F.array(rows, _at(args, 1, 1), columns), scale_of(inner)), volume(F.array(rows, columns), scale_of(outer) * 3)
    return _checked(ok, "addmm expects an addend and matrices that fit", total(product, rest))


def native_layer_norm(args: Column, meta: Column) -> Column:
    """Two operations on each element at its own type, one at the weight's and one at the bias's
    common type; three on each element of the normalised dimensions."""
    shape, rank = _arg(args, 0)["shape"], _rank(args, 1)
    ok = (F.size(args) == 3) & (rank == _rank(args, 2))
    weighted = promoted(_type(args, 0), _type(args, 1))
    biased = promoted(weighted, _type(args, 2))
    own = scale_of(_type(args, 0))
    last = F.slice(shape, F.size(shape) - rank + 1, rank)
    return _checked(ok, "native_layer_norm expects an input and a weight and bias of one rank", total(volume(shape, own * 2 + scale_of(weighted) + scale_of(biased)), volume(last, own * 3)))


def default_rules() -> dict[str, Rule]:
    """The rules of all 50 operators."""
    rules: dict[str, Rule] = {op: per_input(k) for op, k in PER_INPUT.items()}
    rules |= dict.fromkeys(FREE, free)
    rules |= {"ADD_TENSOR": per_output(True), "SUB_TENSOR": per_output(True), "MUL_TENSOR": per_output(False)}
    return rules | {"MM": mm, "BMM": bmm, "ADDMM": addmm, "NATIVE_LAYER_NORM": native_layer_norm}


class Registry:
    """Operators' rules; replaced and removed ones are returned."""

    def __init__(self):
        self.rules = default_rules()
        self._made: tuple | None = None

    def register(self, op: str, rule: Rule) -> Rule | None:
        before = self.rules.get(op)
        self.rules[op] = rule
        return before

    def deregister(self, op: str) -> Rule | None:
        return self.rules.pop(op, None)

    def dispatch(self, target: Column, args: Column, meta: Column) -> Column:
        """The cost of each node; raises for operators without a rule. Rules that are one function share a branch."""
        unknown = F.raise_error(F.concat(F.lit("Cannot find the operator "), F.coalesce(target, F.lit("null")))).cast("struct<c0:bigint,c1:bigint,c2:bigint>")
        out = None
        by_rule: dict[int, tuple[Rule, list[str]]] = {}
        for op, rule in self.rules.items():
            by_rule.setdefault(id(rule), (rule, []))[1].append(op)
        for rule, ops in by_rule.values():
            case = target.isin(ops)
            out = F.when(case, rule(args, meta)) if out is None else out.when(case, rule(args, meta))
        return unknown if out is None else out.otherwise(unknown)


    def cost(self) -> Column:
        """The cost of a row of NODES; made once for the same rules and application."""
        context = SparkContext._active_spark_context
        key = (context and context.applicationId, tuple(self.rules.items()))
        if self._made is None or self._made[0] != key:
            self._made = key, self.dispatch(F.col("target"), F.col("args"), F.col("meta"))
        return self._made[1]


#: The registry that transform() uses unless given another.
REGISTRY = Registry()


def node_costs(nodes: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """nodes with the polynomial `cost`."""
    return nodes.withColumn("cost", registry.cost())


def model_costs(nodes: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """model, c0, c1, c2: the sums of the nodes' costs."""
    sums = [F.sum(f"cost.{c}").cast("bigint").alias(c) for c in ("c0", "c1", "c2")]
    return node_costs(nodes, registry).groupBy("model").agg(*sums)


def transform(nodes: DataFrame, tensor_parallel: int = 1, context_parallel: int = 1, registry: Registry = REGISTRY) -> Polynomial:
    """The cost of one graph: the nodes' sum, scaled to the parallel sizes and normalised. No nodes: zero.

    One aggregate row goes to the driver; the result goes back into plans as literals.
    """
    began = time.time()
    sums = [F.coalesce(F.sum(f"cost.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("c0", "c1", "c2")]
    row = node_costs(nodes, registry).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    log.info("Costing a graph of %d nodes took %.3f s", row.n, time.time() - began)
    return Polynomial(row.c0, row.c1, row.c2).with_tensor_parallel(tensor_parallel).with_context_parallel(context_parallel).normalized()
