"""Column functions over vectors (arrays of doubles)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_vector(word: Column, dim: int | Column) -> Column:
    """A normal vector from the word's digest (Box-Muller on slices of md5), the same in any SQL engine."""

    def one(i: Column) -> Column:
        h = F.md5(F.concat(word, F.lit(":"), i.cast("string")))
        u = [(F.conv(F.substring(h, a, 8), 16, 10).cast("double") + 1) / 4294967297.0 for a in (1, 9)]
        return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])

    return F.transform(F.sequence(F.lit(0), (F.lit(dim) if isinstance(dim, int) else dim) - 1), one)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column, floor: float = 1e-8) -> Column:
    """v over its norm plus a floor."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / (n + floor)))[0]


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def softmax(z: Column, temp: float) -> Column:
    """Softmax of an array at a temperature."""
    t = max(temp, 1e-6)

    def with_top(top: Column) -> Column:
        e = F.transform(z, lambda x: F.exp(x / t - top))
        return F.transform(F.array(e), lambda w: F.transform(w, lambda x: x / (total(w) + 1e-12)))[0]

    return F.transform(F.array(F.array_max(z) / t), with_top)[0]


def quantize(x: Column, scale: Column) -> Column:
    """Symmetric INT8: half-even rounding, clipped before the cast."""
    return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale))).cast("tinyint")
