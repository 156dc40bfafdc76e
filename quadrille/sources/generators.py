"""Point and key generators, each row a function of its index and a seed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier, increment and modulus of the 48-bit linear congruential generator (fixed values).
A, C, M = 0x5DEECE66D, 0xB, 1 << 48


def lcg_state(seed: int, n: int) -> int:
    """State after n steps from srand48(seed), by repeated squaring of the affine map."""
    a, c, x = A, C, (seed << 16) + 0x330E
    while n:
        if n & 1:
            x = (a * x + c) % M
        a, c = a * a % M, (a + 1) * c % M
        n >>= 1
    return x


def lcg_run(seed: int, first: int, count: int) -> np.ndarray:
    """States first + 1 .. first + count: runs of doubling length, each the one before moved on by its length."""
    low = np.uint64(M - 1)
    states, a, c = np.array([lcg_state(seed, first + 1)], np.uint64), A, C
    while len(states) < count:  # products wrap at 2^64, of which 2^48 is a divisor
        states = np.concatenate([states, (states * np.uint64(a) + np.uint64(c)) & low])
        a, c = a * a % M, (a + 1) * c % M
    return states[:count]


def drand48(spark: SparkSession, n: int, columns: list[str], seed: int = 0) -> DataFrame:
    """(id, columns..): the doubles of the 48-bit generator, row by row."""
    width = len(columns)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids = x.id.to_numpy()
            breaks = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            for lo, hi in zip(breaks, breaks[1:], strict=False):
                if hi > lo:
                    u = lcg_run(seed, int(ids[lo]) * width, (hi - lo) * width).reshape(-1, width) / M
                    yield pd.DataFrame({"id": ids[lo:hi]} | {c: u[:, k] for k, c in enumerate(columns)})

    return spark.range(n).mapInPandas(fill, "id long, " + ", ".join(f"{c} double" for c in columns))


def uniform(spark: SparkSession, n: int, columns: list[str], seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", *[F.rand(seed + k).alias(c) for k, c in enumerate(columns)])


def block_streams(spark: SparkSession, n: int, blocks: int = 48) -> DataFrame:
    """(id, x, y): a seeded MT19937 stream for each block of n div blocks rows, the tail in the last; x, then y."""
    size = max(1, n // blocks)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for b in x.id:
                lo, hi = int(b) * size, n if b == blocks - 1 else min(n, (int(b) + 1) * size)
                raw = np.random.RandomState(int(b)).randint(0, 2**32, size=4 * max(0, hi - lo), dtype=np.uint64)
                u = np.minimum((raw[0::2] + raw[1::2] * 2.0**32) / 2.0**64, 1 - 2.0**-53)
                yield pd.DataFrame({"id": np.arange(lo, hi), "x": u[0::2], "y": u[1::2]})

    return spark.range(blocks).mapInPandas(fill, "id long, x double, y double")


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, q): n equal charges evenly spaced on [0, 2 pi)."""
    return spark.range(n).select("id", ((F.col("id") + 0.5) * (2 * math.pi / n)).alias("x"), F.lit(1.0).alias("q"))


def disc(spark: SparkSession, n: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x, y, z): points of a flattened ball."""
    r, t, p = F.rand(seed) * radius, F.rand(seed + 1) * (2 * math.pi), F.rand(seed + 2) * math.pi
    rows = spark.range(n).select("id", r.alias("r"), t.alias("t"), p.alias("p"))
    return rows.select("id", (F.col("r") * F.sin("p") * F.cos("t")).alias("x"), (F.col("r") * F.sin("p") * F.sin("t")).alias("y"), F.lit(0.0).alias("z"))


def shuffled_keys(spark: SparkSession, n: int, each: int = 10, seed: int = 0) -> DataFrame:
    """(key): each value of 0 .. n / each - 1 so many times, in random order."""
    return spark.range(n).select(F.expr(f"id div {each}").alias("key")).orderBy(F.rand(seed))


def indexed_fill(spark: SparkSession, groups: int, size: int) -> DataFrame:
    """(id, value): 10 times the group and the place in it."""
    return spark.range(groups * size).select("id", (10 * F.expr(f"id div {size}") + F.col("id") % size).alias("value"))


def exponential_fill(spark: SparkSession, n: int) -> DataFrame:
    """(id, value): exp(id * pi) as a 4-byte float, infinite where that overflows."""
    return spark.range(n).select("id", F.exp(F.col("id") * F.pi()).cast("float").alias("value"))
