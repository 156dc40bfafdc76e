"""Arithmetic on array<double> columns as small fixed vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, by) -> Column:
    return F.transform(a, lambda x: x * by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    """Squared length."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def least(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def greatest(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def absolute(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def greater(a: Column, b: Column) -> Column:
    """Element-wise a > b as an array of booleans."""
    return F.zip_with(a, b, lambda x, y: x > y)


def greater_equal(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x >= y)


def less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x < y)


def less_equal(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x <= y)


def equal(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x == y)


def differs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x != y)


def both(a: Column, b: Column) -> Column:
    """Element-wise and of booleans."""
    return F.zip_with(a, b, lambda x, y: x & y)


def either(a: Column, b: Column) -> Column:
    """Element-wise or of booleans."""
    return F.zip_with(a, b, lambda x, y: x | y)


def chosen(mask: Column, a: Column, b: Column) -> Column:
    """a where the mask holds, else b."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(mask, pairs, lambda m, p: F.when(m, p["x"]).otherwise(p["y"]))


def mask_bits(mask: Column) -> Column:
    """The mask, of 64 elements at most, as a number: bit k is element k."""
    shifted = F.zip_with(mask, F.lit([1 << k if k < 63 else -(1 << 63) for k in range(64)]), lambda m, bit: F.when(m, bit).otherwise(F.lit(0).cast("long")))
    return F.aggregate(shifted, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def reciprocal_sqrt(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / F.sqrt(x))


def wrap(a: Column, width: float) -> Column:
    """Each component moved by one width into [-width/2, width/2]."""
    half = width / 2
    return F.transform(a, lambda x: F.when(x < -half, x + width).when(x > half, x - width).otherwise(x))


def wrap_mask(a: Column, width: float) -> Column:
    """Bit k is set where wrap() moves component k, of 64 at most."""
    half = width / 2
    return mask_bits(F.transform(a, lambda x: (x < -half) | (x > half)))


def unwrap(a: Column, mask: Column, width: float) -> Column:
    """The components that wrap() moved, put back: a moved component goes a width towards its own sign's other side."""
    back = lambda x, k: F.when(F.getbit(mask, k) == 1, F.when(x > 0, x - width).otherwise(x + width)).otherwise(x)
    return F.zip_with(a, F.sequence(F.lit(0), F.size(a) - 1), back)
