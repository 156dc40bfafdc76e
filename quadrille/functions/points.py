"""Point sets derived from tables, grid indices and space-filling-curve keys, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest float32 below one: a coordinate of exactly one belongs to the last cell.
BELOW_ONE = 1 - 2.0**-24


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def square_points(part: DataFrame) -> DataFrame:
    """(id, x, y) in the unit square by quadratic residues of the part key."""
    k = F.col("p_partkey")
    return part.select(k.alias("id"), ((k * k * 31 + k * 7919) % 20011 / F.lit(20011.0)).alias("x"), ((k * k * 17 + k * 104729) % 20021 / F.lit(20021.0)).alias("y"))


def cube_points(part: DataFrame) -> DataFrame:
    """square_points with a third axis."""
    k = F.col("p_partkey")
    z = part.select(k.alias("id"), ((k * k * 13 + k * 15485863) % 20023 / F.lit(20023.0)).alias("z"))
    return square_points(part).join(z, "id")


def crowded_points(part: DataFrame, axes: str = "xyz") -> DataFrame:
    """(id, axes..) off the unit box: a quarter of cube_points spread over [-3, 5), the others in six crowds 1e-4 wide."""
    group, at = F.col("id") % 8, {"x": 0.37, "y": -0.21, "z": 0.11}
    return cube_points(part).select("id", *[F.when(group < 2, F.col(a) * 8 - 3).otherwise(group * at[a] + F.col(a) * 1e-4).alias(a) for a in axes])


def item_points(lineitem: DataFrame) -> DataFrame:
    """(x, y, z) in the unit cube for each order line."""
    x, y = (F.col("l_quantity") - 1) / F.lit(50.0), F.col("l_extendedprice") / F.lit(105000.0)
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"), (F.col("l_partkey") % 997 / F.lit(997.0)).alias("z"))


def grid_index(x: Column, cells: int, low: float = 0.0, width: float = 1.0) -> Column:
    """Cell of x among ``cells`` equal ones of [low, low + width), the end clamped into the last."""
    return F.floor(F.least((x - low) / F.lit(float(width)), F.lit(BELOW_ONE)) * cells).cast("long")


def interleave(axes: list[Column], level: int) -> Column:
    """Morton key of ``level`` bits of each axis; the first axis has the lowest bit."""
    d = len(axes)
    bits = [F.shiftleft(F.shiftright(a, b).bitwiseAND(F.lit(1).cast("long")), d * b + k) for b in range(level) for k, a in enumerate(axes)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def deinterleave(key: Column, axis: int, axes: int, level: int) -> Column:
    bits = [F.shiftleft(F.shiftright(key, axes * b + axis).bitwiseAND(F.lit(1).cast("long")), b) for b in range(level)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def morton2(ix: Column, iy: Column, level: int, x_lowest: bool = False) -> Column:
    """2-D key; the teaching programs put y in the even bits, the tree codes put x there."""
    return interleave([ix, iy] if x_lowest else [iy, ix], level)


def morton3(ix: Column, iy: Column, iz: Column, level: int) -> Column:
    return interleave([ix, iy, iz], level)


def parent(key: Column, axes: int) -> Column:
    return F.shiftright(key, axes)


def adaptive_level(rows: int, ncrit: int, axes: int) -> int:
    """Depth of a uniform tree with about ncrit points in a leaf."""
    ratio, level = rows // ncrit, 0
    while ratio >= 1 and 2 ** (axes * level) <= ratio:
        level += 1
    return level


def octant(x: Column, y: Column, z: Column, xc: Column, yc: Column, zc: Column) -> Column:
    return (x > xc).cast("int") + 2 * (y > yc).cast("int") + 4 * (z > zc).cast("int")


def two_level_bin(x: Column, major: int, minor: int) -> tuple[Column, Column]:
    """(high, low) of the bin of x in [0, 1) among major * minor bins."""
    b = grid_index(x, major * minor)
    return F.floor(b / minor).cast("long"), b % minor
