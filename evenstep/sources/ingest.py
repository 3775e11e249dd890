"""Ingestion of exported operator graphs into the node table.

An exported node is a row (NODE): kind of target, target and overload names, its tensor arguments
and output. Accessors and other targets are skipped; operators without a rule are skipped with
one warning that names them. Nodes as exporters write them (RAW), with all arguments and with
symbolic dimensions as text, become such rows by parsed().
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstep.functions.cost import TENSOR
from evenstep.functions.dtypes import DTYPES

NODE = f"model string, node_id int, kind string, packet string, overload string, args array<{TENSOR}>, meta {TENSOR}"
#: An argument is of some kind; only tensors among the positional ones count. Dimensions are texts such as "128", "s0" or "2*s0 + 1".
RAW = "model string, node_id int, kind string, packet string, overload string, args array<struct<kind:string,dtype:string,shape:array<string>>>, meta struct<dtype:string,shape:array<string>>"
KINDS = ("overload", "packet", "custom")

# Names of operators by packet and overload; a packet alone stands for all its overloads.
OPERATORS = {
    "_softmax": "_SOFTMAX", "_to_copy": "_TO_COPY", "_unsafe_view": "_UNSAFE_VIEW", "add.Tensor": "ADD_TENSOR", "addmm": "ADDMM",
    "alias": "ALIAS", "all.dim": "ALL_DIM", "arange": "ARANGE", "arange.start": "ARANGE_START", "bitwise_not": "BITWISE_NOT",
    "bmm": "BMM", "cat": "CAT", "clone": "CLONE", "copy": "COPY", "cumsum": "CUMSUM", "embedding": "EMBEDDING",
    "eq.Scalar": "EQ_SCALAR", "expand": "EXPAND", "full": "FULL", "gelu": "GELU", "gt.Tensor": "GT_TENSOR", "lt.Tensor": "LT_TENSOR",
    "masked_fill.Scalar": "MASKED_FILL_SCALAR", "mean.dim": "MEAN_DIM", "mm": "MM", "mul.Scalar": "MUL_SCALAR", "mul.Tensor": "MUL_TENSOR",
    "native_layer_norm": "NATIVE_LAYER_NORM", "neg": "NEG", "ones": "ONES", "ones_like": "ONES_LIKE", "permute": "PERMUTE",
    "pow.Tensor_Scalar": "POW_TENSOR_SCALAR", "relu": "RELU", "rsqrt": "RSQRT", "rsub.Scalar": "RSUB_SCALAR", "scalar_tensor": "SCALAR_TENSOR",
    "silu": "SILU", "slice.Tensor": "SLICE_TENSOR", "slice_scatter": "SLICE_SCATTER", "split.Tensor": "SPLIT_TENSOR", "sub.Tensor": "SUB_TENSOR",
    "t": "T", "tanh": "TANH", "transpose.int": "TRANSPOSE_INT", "tril": "TRIL", "triu": "TRIU", "unsqueeze": "UNSQUEEZE", "view": "VIEW",
    "where.self": "WHERE_SELF",
}


class UnsupportedOperatorWarning(UserWarning):
    """Operators that have no rule; their nodes were skipped."""

    def __init__(self, *names: str):
        super().__init__(f"operators without a cost were skipped: {', '.join(sorted(set(names)))}")


_SYMBOL = r"[A-Za-z_]\w*"
_CONSTANT, _LINEAR, _POWER = r"^-?\d+$", rf"^-?((\d+\*)?{_SYMBOL}|{_SYMBOL}\*\d+)$", rf"^-?(\d+\*)?{_SYMBOL}\*\*\d+$"


def dimension(text: Column) -> Column:
    """A dimension's text as (c0, c1): the coefficients of degree zero and one of its symbol.

    Sums of whole numbers, multiples of a symbol and its powers, which add to neither. Other
    texts, and sums of several symbols, raise; so does a null.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"(?<=\w)-", "+-")
    terms = F.filter(F.split(plain, r"(?<!^)\+|^\+"), lambda t: t != "")

    def parts(t: Column) -> Column:
        sign = F.when(t.startswith("-"), -1).otherwise(1).cast("bigint")
        number = F.coalesce(F.nullif(F.regexp_extract(t, r"(?<![A-Za-z_0-9])(\d+)", 1), F.lit("")), F.lit("1")).cast("bigint")
        zero = F.lit(0).cast("bigint")
        pair = lambda a, b: F.struct(a.alias("c0"), b.alias("c1"))
        wrong = F.raise_error(F.concat(F.lit("Unknown dimension "), text)).cast("struct<c0:bigint,c1:bigint>")
        return F.when(t.rlike(_CONSTANT), pair(sign * number, zero)).when(t.rlike(_LINEAR), pair(zero, sign * number)).when(t.rlike(_POWER), pair(zero, zero)).otherwise(wrong)

    plus = lambda a, b: F.struct((a["c0"] + b["c0"]).alias("c0"), (a["c1"] + b["c1"]).alias("c1"))
    start = F.struct(F.lit(0).cast("bigint").alias("c0"), F.lit(0).cast("bigint").alias("c1"))
    summed = F.aggregate(F.transform(terms, parts), start, plus)
    symbols = F.size(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({_SYMBOL})"))))
    wrong = F.raise_error(F.concat(F.lit("Unknown dimension "), F.coalesce(text, F.lit("null")))).cast("struct<c0:bigint,c1:bigint>")
    return F.when((F.size(terms) > 0) & (symbols <= 1) & ~text.rlike(r"\w\s+\w"), summed).otherwise(wrong)


def parsed(raw: DataFrame) -> DataFrame:
    """Rows of RAW as rows of NODE: arguments that are no tensors go, dimensions become pairs."""
    sized = lambda t: F.struct(t["dtype"].alias("dtype"), F.transform(t["shape"], dimension).alias("shape"))
    args = F.transform(F.filter("args", lambda a: (a["kind"] == "tensor") & a["dtype"].isNotNull()), sized)
    meta = F.when(F.col("meta").isNotNull(), sized(F.col("meta")))
    return raw.select("model", "node_id", "kind", "packet", "overload", args.alias("args"), meta.alias("meta"))


def operator_name() -> Column:
    """The operator of a row of NODE: its overload's, else its packet's; null if there is none."""
    table = F.create_map(*(F.lit(x) for kv in OPERATORS.items() for x in kv))
    full = F.concat_ws(".", "packet", "overload")
    return F.coalesce(F.try_element_at(table, full), F.try_element_at(table, F.col("packet")))


def targets(exported: DataFrame) -> DataFrame:
    """Nodes that call an operator, with `target`."""
    return exported.where(F.col("kind").isin(*KINDS)).withColumn("target", operator_name())


def unsupported(exported: DataFrame) -> DataFrame:
    """Distinct names of called operators without a rule."""
    return targets(exported).where("target is null").select(F.concat_ws(".", "packet", "overload").alias("operator")).distinct()


def ingest(exported: DataFrame, warn: bool = True) -> DataFrame:
    """The node table (model, node_id, target, args, meta).

    A missing output is an empty shape of FLOAT32; types outside the list raise. warn looks for
    operators without a rule, whose names (a set as small as an operator library) go to the driver.
    """
    if warn and (names := [r.operator for r in unsupported(exported).collect()]):
        warnings.warn(UnsupportedOperatorWarning(*names), stacklevel=2)
    known = lambda t: t["dtype"].isin(*DTYPES)
    empty = F.from_json(F.lit('{"dtype": "FLOAT32", "shape": []}'), TENSOR)
    meta = F.when(F.col("meta").isNull(), empty).otherwise(F.struct(F.coalesce("meta.dtype", F.lit("FLOAT32")).alias("dtype"), F.coalesce("meta.shape", F.array().cast("array<struct<c0:bigint,c1:bigint>>")).alias("shape")))
    args = F.coalesce("args", F.array().cast(f"array<{TENSOR}>"))
    rows = targets(exported).where("target is not null").select("model", "node_id", "target", args.alias("args"), meta.alias("meta"))
    right = F.forall("args", known) & known(F.col("meta"))
    return rows.withColumn("target", F.when(right, F.col("target")).otherwise(F.raise_error("an unknown data type").cast("string")))
