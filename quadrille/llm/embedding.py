"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are one class.  A k-d tree over the leading PCA axes deals the classes into tiles; pairs of tiles whose
boxes are too far apart are dropped.  Within a pair of tiles the dot products of the leading dimensions come first; what
the rest can add is bounded by the product of the suffix norms (Cauchy-Schwarz), and pairs that cannot reach the
threshold stop there.  What is left is compared in full, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, shuffle_partitions
from .local_sets import merge

#: Classes aimed at for a tile, and the most tiles of the tree (larger ones are dealt in chunks of TILE classes by a hash);
#: rows that the basis and the tile bounds are fitted on (any basis gives the same links);
#: leading dimensions of each step; dimensions that the tree and the boxes look at; rows of a tile compared at a time;
#: share of a block's pairs up to which they go on one by one.
TILE, TILES, BASIS_ROWS, STEPS, AXES, ROWS, SINGLE = 8192, 1024, 8192, (16, 32), 8, 256, 0.05
SLACK = 1e-9


def padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Basis:
    """An orthonormal basis by falling variance, and a k-d tree over its leading axes."""

    def __init__(self, sample: np.ndarray, tiles: int):
        value, vector = np.linalg.eigh(sample.T @ sample)
        self.axes = vector[:, np.argsort(-value)]
        self.cuts: list[np.ndarray] = []  # of each depth, by node
        x, node = sample @ self.axes[:, :AXES], np.zeros(len(sample), np.int64)
        while 2 ** len(self.cuts) < tiles:
            axis = len(self.cuts) % x.shape[1]
            at = np.array([np.median(x[node == k, axis]) if (node == k).any() else 0.0 for k in range(2 ** len(self.cuts))])
            self.cuts.append(at)
            node = 2 * node + (x[:, axis] > at[node])

    def tile(self, lead: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lead), np.int64)
        for depth, at in enumerate(self.cuts):
            node = 2 * node + (lead[:, depth % lead.shape[1]] > at[node])
        return node


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b (of length one) with cosine >= least; of one set, i < j.

    Products of the leading dimensions add up step by step; after each the pairs that cannot reach the threshold, even if
    the rest of the two vectors were parallel, stop.  A step works on the whole block while many of its pairs are left, and
    on single pairs from then on; the products and the bounds are the same.
    """
    ra, rb = a @ basis, b @ basis
    edges = [0, *(k for k in STEPS if k < a.shape[1]), a.shape[1]]
    rest = [[np.sqrt((r[:, k:] ** 2).sum(1)) for k in edges] for r in (ra, rb)]
    for s in range(0, len(a), ROWS):
        block, pairs = np.zeros((min(ROWS, len(a) - s), len(b))), None
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False), 1):
            if pairs is None:
                block += ra[s : s + ROWS, lo:hi] @ rb[:, lo:hi].T
                i, j = np.nonzero(block + np.outer(rest[0][k][s : s + ROWS], rest[1][k]) >= least - SLACK)
                if len(i) <= SINGLE * block.size or hi == edges[-1]:
                    pairs = i + s, j, block[i, j]
                    if same:
                        pairs = tuple(x[i + s < j] for x in pairs)
            else:
                i, j, cos = pairs
                cos = cos + (ra[i, lo:hi] * rb[j, lo:hi]).sum(1)
                go = cos + rest[0][k][i] * rest[1][k][j] >= least - SLACK
                pairs = i[go], j[go], cos[go]
        i, j, cos = pairs
        sure, edge = cos >= least + SLACK, np.flatnonzero(cos < least + SLACK)
        sure[edge] = np.einsum("ij,ij->i", a[i[edge]], b[j[edge]]) >= least
        yield i[sure], j[sure]


def near_duplicates(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links are pairs of rows with cosine >= least.

    Null, zero and empty vectors and those with a null, NaN or infinite component link with nothing, and are a component
    each.  Vectors of different lengths compare as if the shorter ended in zeros.  Equal vectors and repeated rows link
    with each other as any two rows do.  A null id counts only where its component has no other.  Other columns aren't read,
    whatever their names.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("v", F.expr(f"case when {good} then v end"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size.n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = size.width
    drawn = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1, BASIS_ROWS / size.n)))
    sample = classes.where(drawn).select("rep", "v").toPandas().sort_values("rep")  # BASIS_ROWS, about
    vectors_of = unit(padded(sample.v, width)) if len(sample) else np.eye(width)
    basis = Basis(vectors_of, min(TILES, max(-(-size.n // TILE), math.isqrt(shuffle_partitions(spark)))))

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lead = unit(padded(x.v, width)) @ basis.axes[:, :AXES] if len(x) else np.zeros((0, AXES))
            yield pd.DataFrame({"rep": x.rep, "weight": x.weight, "v": x.v, "tile": basis.tile(lead), "lead": list(lead)})

    tiles = cut(classes.select("rep", "weight", "v").mapInPandas(tiled, "rep long, weight long, v array<double>, tile long, lead array<double>"))
    axes = range(min(AXES, width))
    boxes = tiles.groupBy("tile").agg(F.array(*[F.min(F.get("lead", F.lit(k))) for k in axes]).alias("lo"), F.array(*[F.max(F.get("lead", F.lit(k))) for k in axes]).alias("hi"), F.count("*").alias("n")).collect()  # TILES at most
    tile, lo, hi, n = (np.array([x[k] for x in boxes]) for k in ("tile", "lo", "hi", "n"))
    chunks = dict(zip(tile.tolist(), (-(-n // TILE)).tolist(), strict=True))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(t, u) of tiles that may hold a link: two points of length one with that cosine are at most sqrt(2 - 2 * least) apart."""
        for x in batches:
            for t in x.id:
                k = int(np.flatnonzero(tile == t)[0])
                gap = np.maximum(0, np.maximum(lo - hi[k], lo[k] - hi))
                yield pd.DataFrame({"t": t, "u": tile[(tile >= t) & ((gap**2).sum(1) <= 2 - 2 * least + SLACK)]})

    chunks_of = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]), F.col(c)), F.lit(1))
    some = spark.createDataFrame([(x,) for x in chunks], "id long")
    live = cut(some.mapInPandas(partners, "t long, u long"))
    live = live.withColumn("i", F.explode(F.sequence(F.lit(0), chunks_of("t") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), chunks_of("u") - 1)))
    live = live.where("t < u or i <= j").withColumn("pair", F.concat_ws("-", "t", "i", "u", "j"))
    side = "array(struct(t as tile, i as chunk, true as first), struct(u as tile, j as chunk, false as first))"
    sides = live.select("pair", F.explode(F.expr(f"if(t = u and i = j, slice({side}, 1, 1), {side})")).alias("x")).select("pair", "x.*")
    dealt = tiles.select("rep", "weight", "v", "tile", F.pmod(F.xxhash64("rep"), chunks_of("tile")).cast("int").alias("chunk")).join(sides, ["tile", "chunk"]).drop("tile", "chunk")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        a, b = (x[x["first"]], x[~x["first"]])
        same = not len(b)
        b = a if same else b
        both = a if same else pd.concat([a, b])
        shift = 0 if same else len(a)
        links, labels = np.zeros(len(both), np.int64), np.arange(len(both))
        wa, wb = a.weight.to_numpy(), b.weight.to_numpy()
        for i, j in close_pairs(unit(padded(a.v, width)), unit(padded(b.v, width)), basis.axes, least, same):
            np.add.at(links, i, wb[j])
            np.add.at(links, j + shift, wa[i])
            labels = merge(labels, i, j + shift)
        rep = both.rep.to_numpy()
        return pd.DataFrame({"rep": rep, "links": links, "root": rep[labels]})[links > 0]

    found = cut(dealt.groupBy("pair").applyInPandas(compare, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    sets = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    joined = classes.join(counts, "rep", "left").join(sets.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.select("v", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    lowest = cut(joined.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(joined.join(lowest, "root").select("v", "n_links", "component_id"))
    out = rows.join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
