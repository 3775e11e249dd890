"""Quadratic polynomials c0 + c1*s + c2*s**2 with 64-bit coefficients.

As columns they are structs (c0, c1, c2) of bigint; the Polynomial class is the same algebra for
single values on the driver. Products drop all terms above the second degree.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd as _gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POLY = "struct<c0:bigint,c1:bigint,c2:bigint>"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _fits(x: int) -> int:
    if not LEAST <= x <= MOST:
        raise OverflowError("a coefficient leaves 64 bits")
    return x


def gcd(a: int, b: int) -> int:
    """Greatest common divisor of absolute values; of the least 64-bit number and 0 it is 2**63."""
    return _gcd(a, b)


def _truncated(a: int, b: int) -> int:
    """a / b towards zero."""
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


@dataclass(frozen=True)
class Polynomial:
    c0: int = 0
    c1: int = 0
    c2: int = 0

    @classmethod
    def constant(cls, c: int) -> Polynomial:
        return cls(c)

    @classmethod
    def symbol(cls, c0: int, c1: int) -> Polynomial:
        """A dimension c0 + c1*s."""
        return cls(c0, c1)

    def _each(self, f) -> Polynomial:
        return Polynomial(*(_fits(f(c)) for c in (self.c0, self.c1, self.c2)))

    def __add__(self, other: Polynomial | int) -> Polynomial:
        other = other if isinstance(other, Polynomial) else Polynomial(other)
        return Polynomial(_fits(self.c0 + other.c0), _fits(self.c1 + other.c1), _fits(self.c2 + other.c2))

    __radd__ = __add__

    def __neg__(self) -> Polynomial:
        return self._each(lambda c: -c)

    def __sub__(self, other: Polynomial | int) -> Polynomial:
        other = other if isinstance(other, Polynomial) else Polynomial(other)
        return Polynomial(_fits(self.c0 - other.c0), _fits(self.c1 - other.c1), _fits(self.c2 - other.c2))

    def __rsub__(self, other: int) -> Polynomial:
        return Polynomial(other) - self

    def __mul__(self, other: Polynomial | int) -> Polynomial:
        if isinstance(other, int):
            return self._each(lambda c: c * other)
        return Polynomial(
            _fits(self.c0 * other.c0),
            _fits(self.c0 * other.c1 + self.c1 * other.c0),
            _fits(self.c0 * other.c2 + self.c1 * other.c1 + self.c2 * other.c0),
        )

    __rmul__ = __mul__

    def __truediv__(self, k: int) -> Polynomial:
        return self._each(lambda c: _truncated(c, k))

    def __lshift__(self, k: int) -> Polynomial:
        return self._each(lambda c: c << k)

    def __rshift__(self, k: int) -> Polynomial:
        return self._each(lambda c: c >> k)

    def with_tensor_parallel(self, size: int) -> Polynomial:
        """The linear part costs 1/size; where that is no integer the quadratic part costs size times as much."""
        if size <= 0:
            raise ValueError("the tensor-parallel world size must be positive")
        if self.c1 % size == 0:
            return Polynomial(self.c0, _truncated(self.c1, size), self.c2)
        return Polynomial(self.c0, self.c1, _fits(self.c2 * size))

    def with_context_parallel(self, size: int) -> Polynomial:
        """The quadratic part costs 1/size; where that is no integer the linear part costs size times as much."""
        if size <= 0:
            raise ValueError("the context-parallel world size must be positive")
        if self.c2 % size == 0:
            return Polynomial(self.c0, self.c1, _truncated(self.c2, size))
        return Polynomial(self.c0, _fits(self.c1 * size), self.c2)

    def normalized(self) -> Polynomial:
        """Without the constant and the common factor of the others: the same order of equal numbers of sizes."""
        d = gcd(self.c1, self.c2)
        return Polynomial(0, _truncated(self.c1, d), _truncated(self.c2, d)) if d else Polynomial()

    def __call__(self, size: int) -> int:
        return _fits(self.c0 + size * (self.c1 + size * self.c2))

    def at(self, size: Column) -> Column:
        """The value at a bigint column, by Horner's rule."""
        return evaluate(self.lit(), size)

    def lit(self) -> Column:
        return poly(self.c0, self.c1, self.c2)


def poly(c0=0, c1=0, c2=0) -> Column:
    """A polynomial column of three numbers or columns."""
    cast = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("bigint")
    return F.struct(cast(c0).alias("c0"), cast(c1).alias("c1"), cast(c2).alias("c2"))


def evaluate(p: Column, size: Column) -> Column:
    return p["c0"] + size * (p["c1"] + size * p["c2"])


def add(a: Column, b: Column) -> Column:
    return poly(a["c0"] + b["c0"], a["c1"] + b["c1"], a["c2"] + b["c2"])


def subtract(a: Column, b: Column) -> Column:
    return poly(a["c0"] - b["c0"], a["c1"] - b["c1"], a["c2"] - b["c2"])


def negate(p: Column) -> Column:
    return poly(-p["c0"], -p["c1"], -p["c2"])


def add_scalar(p: Column, k) -> Column:
    return poly(p["c0"] + k, p["c1"], p["c2"])


def scale(p: Column, k) -> Column:
    return poly(p["c0"] * k, p["c1"] * k, p["c2"] * k)


def multiply(a: Column, b: Column) -> Column:
    return poly(a["c0"] * b["c0"], a["c0"] * b["c1"] + a["c1"] * b["c0"], a["c0"] * b["c2"] + a["c1"] * b["c1"] + a["c2"] * b["c0"])


def divide(p: Column, k) -> Column:
    """Each coefficient divided towards zero."""
    k = k if isinstance(k, Column) else F.lit(k).cast("bigint")
    return poly(*(F.call_function("div", p[c], k) for c in ("c0", "c1", "c2")))


def shift_left(p: Column, k: int) -> Column:
    return poly(*(F.shiftleft(p[c], k) for c in ("c0", "c1", "c2")))


def shift_right(p: Column, k: int) -> Column:
    return poly(*(F.shiftright(p[c], k) for c in ("c0", "c1", "c2")))


def tensor_parallel(p: Column, size: int) -> Column:
    even = p["c1"] % size == 0
    return poly(p["c0"], F.when(even, F.call_function("div", p["c1"], F.lit(size).cast("bigint"))).otherwise(p["c1"]), F.when(even, p["c2"]).otherwise(p["c2"] * size))


def context_parallel(p: Column, size: int) -> Column:
    even = p["c2"] % size == 0
    return poly(p["c0"], F.when(even, p["c1"]).otherwise(p["c1"] * size), F.when(even, F.call_function("div", p["c2"], F.lit(size).cast("bigint"))).otherwise(p["c2"]))


def _gcds(a: pa.Array, b: pa.Array) -> pa.Array:
    """gcd of whole columns; as a long, 2**63 reads LEAST."""
    null = np.logical_or(*(c.is_null().to_numpy(zero_copy_only=False) for c in (a, b)))
    sizes = [np.abs(c.fill_null(0).to_numpy(zero_copy_only=False)).view(np.uint64) for c in (a, b)]  # abs leaves LEAST, whose bits are 2**63
    return pa.array(np.gcd(*sizes).view(np.int64), mask=null)


def gcd_column(a: Column, b: Column) -> Column:
    """gcd of two long columns as decimal(20,0), which also holds 2**63; by numpy, a batch at a time."""
    return F.abs(F.arrow_udf(_gcds, "long")(a.cast("long"), b.cast("long")).cast("decimal(20,0)"))


def normalize(p: Column) -> Column:
    """Polynomial.normalized() as a column."""
    d = gcd_column(p["c1"], p["c2"])
    by = F.when(d == 0, F.lit(1).cast("decimal(20,0)")).otherwise(d)
    part = lambda c: (p[c].cast("decimal(20,0)") / by).cast("bigint")
    return poly(0, part("c1"), part("c2"))
