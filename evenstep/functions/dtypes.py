"""Tensor data types as tags: relative cost and promotion."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The data types in the order of their numbers, and their relative costs.
DTYPES = (
    "FLOAT32", "FLOAT64", "FLOAT16", "BFLOAT16", "BOOL", "INT8", "INT16", "INT32", "INT64",
    "UINT8", "UINT16", "UINT32", "UINT64", "FLOAT8_E4M3FN", "FLOAT8_E4M3FNUZ", "FLOAT8_E5M2", "FLOAT8_E5M2FNUZ",
)
SCALE = {
    "FLOAT32": 4, "FLOAT64": 64, "FLOAT16": 2, "BFLOAT16": 2, "BOOL": 64, "INT8": 1, "INT16": 64, "INT32": 64, "INT64": 128,
    "UINT8": 1, "UINT16": 64, "UINT32": 64, "UINT64": 128, "FLOAT8_E4M3FN": 1, "FLOAT8_E4M3FNUZ": 1, "FLOAT8_E5M2": 1, "FLOAT8_E5M2FNUZ": 1,
}

FLOAT8 = frozenset(d for d in DTYPES if d.startswith("FLOAT8"))
FLOATING = frozenset(d for d in DTYPES if "FLOAT" in d)
WIDE_UNSIGNED = frozenset(("UINT16", "UINT32", "UINT64"))
_SIGNED = ("INT8", "INT16", "INT32", "INT64")


def promote(left: str, right: str) -> str | None:
    """The smallest type that holds both kinds; None where promotion is not defined.

    Floats win over integers and keep their width, unequal halves meet in FLOAT32; of signed
    integers the wider wins, UINT8 needs the next wider signed type, BOOL yields to all.
    """
    if left not in SCALE or right not in SCALE:
        return None
    if left == right:
        return left
    pair = {left, right}
    if pair & FLOAT8:
        return None
    floats = [d for d in (left, right) if d in FLOATING]
    if floats:
        if len(floats) == 1:
            return floats[0]
        return "FLOAT64" if "FLOAT64" in pair else "FLOAT32"
    if pair & WIDE_UNSIGNED:
        return None
    if "BOOL" in pair:
        return (pair - {"BOOL"}).pop()
    if "UINT8" in pair:
        other = (pair - {"UINT8"}).pop()
        return "INT16" if other == "INT8" else other
    return max(pair, key=_SIGNED.index)


#: All defined promotions, by "left|right".
PROMOTIONS = {f"{a}|{b}": c for a, b in product(DTYPES, DTYPES) if (c := promote(a, b)) is not None}
_LETTERS = "abcdefghijklmnopq"
#: A letter for each pair's result, row by row; '-' where there is none.
_CELLS = "".join(_LETTERS[DTYPES.index(c)] if (c := promote(a, b)) else "-" for a, b in product(DTYPES, DTYPES))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that the plan holds once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scale_of(dtype: Column) -> Column:
    """Relative cost as bigint; raises for unknown types."""
    table = F.str_to_map(F.lit(",".join(f"{d}:{k}" for d, k in SCALE.items())), F.lit(","), F.lit(":"))
    said = lambda d: F.raise_error(F.concat(F.lit("Unknown data type "), F.coalesce(d, F.lit("null"))))
    return let(dtype, lambda d: F.coalesce(F.try_element_at(table, d), said(d).cast("string")).cast("bigint"))


def promoted(left: Column, right: Column) -> Column:
    """promote() as a column; raises where promotion is not defined."""
    types = F.split(F.lit(" ".join(DTYPES)), " ")

    def found(pair: Column) -> Column:
        row, column = F.array_position(types, F.substring_index(pair, "|", 1)), F.array_position(types, F.substring_index(pair, "|", -1))
        cell = F.substr(F.lit(_CELLS), ((row - 1) * len(DTYPES) + column).cast("int"), F.lit(1))
        result = F.get(types, F.instr(F.lit(_LETTERS), cell) - 1)
        return F.coalesce(F.when((row > 0) & (column > 0), result), F.raise_error(F.concat(F.lit("No promotion for "), pair)).cast("string"))

    return let(F.concat_ws("|", left, right), found)
