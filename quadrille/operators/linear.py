"""Clusters, products and transforms of vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lineage import cut

#: Side of a tile; tiles of a result that a task holds at a time (0.6 MB each).
TILE, HELD = 256, 64
#: Ratio of two factors up to which a transform is cut into them; length of a row that one task may transform in any case.
UNEVEN, WHOLE = 64, 1 << 16


def nearest(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """points (id, v) with k and d2 of the nearest centroid, the first of equals.  Centroids are a short list of parameters."""
    def apart(k: int, c: list[float]) -> Column:
        return F.struct(V.norm2(V.sub(F.col("v"), F.array(*[F.lit(float(x)) for x in c]))).alias("d2"), F.lit(k).alias("k"))

    best = F.array_min(F.array(*[apart(k, c) for k, c in enumerate(centroids)])) if centroids else F.lit(None)
    return points.withColumn("__b", best).select(*points.columns, F.col("__b.k").alias("k"), F.col("__b.d2").alias("d2"))


def kmeans(points: DataFrame, k: int, rounds: int | None = None, settle: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """(points (id, v, k, d2), centroids) after Lloyd's rounds from the k lowest ids.

    Stops after ``rounds``, or when at most N >> settle points changed.  A cluster that empties keeps its centroid.
    """
    centroids = [list(r.v) for r in points.orderBy("id").limit(k).collect()]
    dims, n, old, done = len(centroids[0]) if centroids else 0, points.count(), None, 0
    while centroids:
        at = nearest(points, centroids)
        means = at.groupBy("k").agg(F.count("*").alias("n"), *[F.avg(F.get("v", F.lit(d))).alias(f"m{d}") for d in range(dims)]).collect()
        if rounds is None and old is not None:
            before = nearest(points, old).select("id", F.col("k").alias("was"))
            if at.join(before, "id").where("k <> was").count() <= n >> settle:
                break
        old = [list(c) for c in centroids]
        for r in means:
            centroids[r.k] = [r[f"m{d}"] for d in range(dims)]
        done += 1
        if done == rounds:
            break
    return nearest(points, centroids), centroids


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): product of coordinate matrices (i, k, v) and (k, j, v), entry by entry; see tiled_product() for dense ones."""
    return a.select("i", "k", F.col("v").alias("va")).join(b.select("k", "j", F.col("v").alias("vb")), "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def tiles(entries: DataFrame, row: str, column: str) -> DataFrame:
    """(t<row>, t<column>, e): the entries of a coordinate matrix by TILE x TILE tile, each place once."""
    once = entries.where("v is not null").groupBy(row, column).agg(F.sum(F.col("v").cast("double")).alias("v"))
    at = once.select(*[F.floor(F.col(c) / TILE).cast("long").alias(f"t{c}") for c in (row, column)], F.array(*[F.pmod(F.col(c), F.lit(TILE)).cast("double") for c in (row, column)], "v").alias("e"))
    return at.groupBy(f"t{row}", f"t{column}").agg(F.collect_list("e").alias("e"))  # TILE * TILE entries at most


def tiled_product(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """(i, j, v): alpha A B + beta C of coordinate matrices A (i, k, v), B (k, j, v) and C (i, j, v) with integer indices.

    Tiles of A with TILE entries or more meet those of B that share their k, and are multiplied as dense arrays; each task sums
    what it has of a tile of the result before that moves.  So rows grow with the tiles, not with every pair of entries.
    Entries of emptier tiles meet those of B one by one.  Entries of one place add up, null entries are none.  A place is in
    the result if a pair of entries or one of C is behind it.
    """
    import numpy as np
    import pandas as pd

    def dense(entries) -> np.ndarray:
        e = np.stack(entries)
        out = np.full((TILE, TILE), np.nan)
        out[e[:, 0].astype(int), e[:, 1].astype(int)] = e[:, 2]
        return out

    def multiplied(batches):
        for x in batches:
            sums: dict[tuple[int, int], np.ndarray] = {}
            met: dict[tuple[int, int], np.ndarray] = {}
            for ti, tj, ea, eb in zip(x.ti, x.tj, x.ea, x.eb, strict=True):
                left, right = dense(ea), dense(eb)
                rows, inner, cols = (np.flatnonzero(m) for m in (~np.isnan(left).all(1), ~np.isnan(left).all(0) & ~np.isnan(right).all(1), ~np.isnan(right).all(0)))
                if not len(inner):
                    continue
                left, right = left[np.ix_(rows, inner)], right[np.ix_(inner, cols)]
                seen = (~np.isnan(left)).astype(np.float32) @ (~np.isnan(right)).astype(np.float32) > 0
                key, place = (ti, tj), np.ix_(rows, cols)
                if key not in sums:
                    if len(sums) >= HELD:
                        yield from emitted(sums, met)
                        sums.clear(), met.clear()
                    sums[key], met[key] = np.zeros((TILE, TILE)), np.zeros((TILE, TILE), bool)
                sums[key][place] += np.nan_to_num(left, nan=0.0) @ np.nan_to_num(right, nan=0.0)
                met[key][place] |= seen
            yield from emitted(sums, met)

    def emitted(sums, met):
        for (ti, tj), total in sums.items():
            i, j = np.nonzero(met[ti, tj])
            yield pd.DataFrame({"i": i + ti * TILE, "j": j + tj * TILE, "v": alpha * total[i, j]})

    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"t{c}") for c in ("i", "k")]
    a, b = a.where("v is not null"), b.where("v is not null")
    full = cut(a.groupBy(*tile).agg(F.count("*").alias("n")).where(F.col("n") >= TILE).drop("n"))
    at, names = a.select("*", *tile), ["ti", "tk"]
    few = at.join(full, names, "left_anti").select("i", "k", (F.lit(float(alpha)) * F.col("v")).alias("v"))
    alone = gemm(few, b).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
    left, right = cut(tiles(at.join(full, names, "left_semi").select("i", "k", "v"), "i", "k")), tiles(b, "k", "j")
    right = cut(right.join(left.select("tk").distinct(), "tk", "left_semi"))
    pairs = left.withColumnRenamed("e", "ea").join(right.withColumnRenamed("e", "eb"), "tk").select("ti", "tj", "ea", "eb")
    out = pairs.mapInPandas(multiplied, "i long, j long, v double").unionByName(alone)
    if c is not None:
        out = out.unionByName(c.where("v is not null").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.lit(float(beta)) * F.col("v")).alias("v")))
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dft(series: DataFrame, n: int) -> DataFrame:
    """(k, re, im): forward discrete Fourier transform of (t, re, im), t = 0 .. n-1; n^2 terms, for short series."""
    freq = series.select("t", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    angle = F.lit(-2.0) * F.pi() * ((F.col("k") * F.col("t")) % n).cast("double") / n
    c, s = F.cos(angle), F.sin(angle)
    return freq.groupBy("k").agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))


def two_factors(n: int) -> tuple[int, int]:
    """The most even factors of n, the smaller first."""
    small = math.isqrt(n)
    while n % small:
        small -= 1
    return small, n // small


def stepped_fft(series: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(k, re, im): the transform of (t, re, im), t = 0 .. n - 1, in four steps, of which each is many tasks.

    With n = n1 n2 and t = n2 t1 + t2: transforms of the n2 columns of n1 values, factors exp(-2 pi i k1 t2 / n), a transpose
    (the exchange between the two groupings), transforms of the n1 rows of n2 values; k = k1 + n1 k2.  Times that are absent
    are zeros, those that repeat add up.  Best for n with factors near its root; see long_fft() for any n.
    """
    import numpy as np
    import pandas as pd

    n1, n2 = two_factors(n)
    sign = 1 if inverse else -1
    transform = (lambda x: np.fft.ifft(x) * len(x)) if inverse else np.fft.fft
    once = series.groupBy("t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def columns(g: pd.DataFrame) -> pd.DataFrame:
        t2, x = int(g.b.iloc[0]), np.zeros(n1, complex)
        x[g.a.to_numpy()] = g.re.to_numpy() + 1j * g.im.to_numpy()
        k1 = np.arange(n1)
        y = transform(x) * np.exp(sign * 2j * np.pi * ((k1 * t2) % n) / n)
        return pd.DataFrame({"a": t2, "b": k1, "re": y.real, "im": y.imag})

    def rows(g: pd.DataFrame) -> pd.DataFrame:
        k1, x = int(g.b.iloc[0]), np.zeros(n2, complex)
        x[g.a.to_numpy()] = g.re.to_numpy() + 1j * g.im.to_numpy()
        y = transform(x)
        return pd.DataFrame({"k": k1 + n1 * np.arange(n2), "re": y.real, "im": y.imag})

    grid = once.select(F.floor(F.col("t") / n2).cast("long").alias("a"), F.pmod("t", F.lit(n2)).cast("long").alias("b"), "re", "im")
    turned = grid.groupBy("b").applyInPandas(columns, "a long, b long, re double, im double")
    return turned.groupBy("b").applyInPandas(rows, "k long, re double, im double")


def chirp(at: Column, n: int) -> tuple[Column, Column]:
    """cos and sin of pi t^2 / n, with t^2 brought into [0, 2n) before it loses digits."""
    turn = F.pmod(F.pmod(at, F.lit(2 * n)).cast("decimal(19,0)") * F.pmod(at, F.lit(2 * n)).cast("decimal(19,0)"), F.lit(2 * n).cast("decimal(38,0)")).cast("double")
    angle = F.pi() * turn / n
    return F.cos(angle), F.sin(angle)


def long_fft(series: DataFrame, n: int) -> DataFrame:
    """(k, re, im): the forward transform of (t, re, im), t = 0 .. n - 1, for any n; a long series is many tasks.

    Where n has even factors it is one stepped_fft(); else (a large prime, say) Bluestein's convolution of chirps, by three of
    a power of two.  Times beyond n are left out.
    """
    series = series.where(f"t >= 0 and t < {n}").select(F.col("t").cast("long").alias("t"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    n1, n2 = two_factors(n)
    if n2 <= UNEVEN * n1 or n2 <= WHOLE:
        return stepped_fft(series, n)
    m = 1 << (2 * n - 1).bit_length()
    c, s = chirp(F.col("t"), n)
    times = lambda a, b, c, d: (a * c - b * d, a * d + b * c)
    x = series.select("t", *[v.alias(k) for k, v in zip(("re", "im"), times(F.col("re"), F.col("im"), c, -s), strict=True)])
    each = series.sparkSession.range(n).select(F.col("id").alias("t"))
    wave = each.select(F.explode(F.array_distinct(F.array("t", F.pmod(-F.col("t"), F.lit(m))))).alias("t"), c.alias("re"), s.alias("im"))
    fx, fw = stepped_fft(x, m), stepped_fft(wave, m).select(F.col("k"), F.col("re").alias("wr"), F.col("im").alias("wi"))
    product = fx.join(fw, "k").select(F.col("k").alias("t"), *[v.alias(k) for k, v in zip(("re", "im"), times(F.col("re"), F.col("im"), F.col("wr"), F.col("wi")), strict=True)])
    back = stepped_fft(product, m, inverse=True).where(f"k < {n}")
    c, s = chirp(F.col("k"), n)
    return back.select("k", *[(v / m).alias(k) for k, v in zip(("re", "im"), times(F.col("re"), F.col("im"), c, -s), strict=True)])


def fft(series: DataFrame, by: str) -> DataFrame:
    """(by, k, re, im): the same for long series, each of them one task's array."""
    import numpy as np
    import pandas as pd

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        f = np.fft.fft(g.re.to_numpy() + 1j * g.im.to_numpy())
        return pd.DataFrame({by: g[by].iloc[0], "k": range(len(f)), "re": f.real, "im": f.imag})

    return series.groupBy(by).applyInPandas(one, f"{by} {series.schema[by].dataType.simpleString()}, k long, re double, im double")
