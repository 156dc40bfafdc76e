"""Lloyd's clustering on integers with exponion search (Newling, Fleuret, 2016).

Every vector keeps an upper bound on the distance to its centroid and a lower bound on that to any other.  Centroids move,
and the bounds move with them; a vector whose bounds still part them keeps its centroid unseen.  Any other one scans only
the centroids inside a ball around its own: of radius twice its distance plus the distance to the nearest other centroid,
which holds the two nearest ones.  The ball is a prefix of a list of centroids sorted by distance.  It includes its surface
and the bounds part strictly, so ties are always scanned.  Bounds are in floating point with a margin; distances, sums and
means are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

#: Rounds after which vectors are written again with fresh bounds; margin of the bounds; largest component for which squared
#: distances of 64 of them fit in 64 bits (larger ones count as Python integers).
REFRESH, MARGIN, EXACT = 4, 1e-9, 1 << 27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from c."""
    apart = x - c
    return (apart * apart).sum(1)


class Centroids:
    """Centroids with, for each, the others by distance."""

    def __init__(self, at: list[list[int]]):
        self.at = np.array(at, object)
        if np.abs(self.at).max(initial=0) <= EXACT:
            self.at = self.at.astype(np.int64)
        k = len(at)
        apart = np.sqrt(np.array([squared(self.at, c) for c in self.at], float)) if k else np.zeros((0, 0))
        np.fill_diagonal(apart, -1)  # itself first, also among equals
        self.near = np.argsort(apart, axis=1, kind="stable")
        np.fill_diagonal(apart, 0)
        self.apart = np.take_along_axis(apart, self.near, 1)
        self.gap = self.apart[:, 1] if k > 1 else np.full(k, np.inf)

    def exact(self, x: np.ndarray) -> np.ndarray:
        return x if x.dtype == self.at.dtype else x.astype(object)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, upper, lower) by a scan of every centroid, as nothing is known yet."""
        return self.scan(x, np.zeros(len(x), np.int64), np.full(len(x), len(self.at)))

    def scan(self, x: np.ndarray, own: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same by the first ``count`` centroids in the list of each vector's own."""
        best, second, cluster = np.zeros(len(x), x.dtype), np.full(len(x), np.inf), np.full(len(x), -1)
        for a in np.unique(own):
            rows = np.flatnonzero(own == a)
            for rank in range(int(count[rows].max())):
                live, j = rows[count[rows] > rank], int(self.near[a, rank])
                d2 = squared(x[live], self.at[j])
                was, held = best[live], cluster[live]
                first = held < 0
                wins = first | (d2 < was) | ((d2 == was) & (j < held))
                loser = np.where(first, np.inf, np.where(wins, was, d2).astype(float))
                second[live] = np.minimum(second[live], loser)
                best[live[wins]], cluster[live[wins]] = d2[wins], j
        return cluster, best, np.sqrt(best.astype(float)) * (1 + MARGIN), np.sqrt(second) * (1 - MARGIN)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance or -1 where nothing had to be computed, upper, lower), from bounds that held for ``old``."""
        moved = np.sqrt(np.array(((self.exact(self.at) - old.at) ** 2).sum(1), float))
        others = np.array([np.delete(moved, a).max(initial=0) for a in range(len(moved))])[own]
        upper = (upper + moved[own]) * (1 + MARGIN)
        lower = lower - others - MARGIN * (np.where(np.isinf(lower), 0, lower) + others)
        cluster, d2, edge = own.copy(), np.full(len(x), -1, x.dtype), np.maximum(lower, self.gap[own] / 2 * (1 - MARGIN))
        rows = np.flatnonzero(upper >= edge)
        if len(rows):  # the distance itself is the best upper bound
            for a in np.unique(own[rows]):
                here = rows[own[rows] == a]
                d2[here] = squared(x[here], self.at[a])
            upper[rows] = np.sqrt(d2[rows].astype(float)) * (1 + MARGIN)
            rows = rows[upper[rows] >= edge[rows]]
        if len(rows):
            radius = (2 * upper[rows] + self.gap[own[rows]]) * (1 + MARGIN)
            count = np.zeros(len(rows), np.int64)
            for a in np.unique(own[rows]):
                here = own[rows] == a
                count[here] = np.searchsorted(self.apart[a], radius[here], "right")
            cluster[rows], d2[rows], upper[rows], lower[rows] = self.scan(x[rows], own[rows], count)
        return cluster, d2, upper, lower


def matrix(batch: pa.RecordBatch, centroids: Centroids, width: int) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    big = len(x) and (x.min() < -EXACT or x.max() > EXACT)
    return x.astype(object) if big or centroids.at.dtype == object else x


def bounded(vectors: DataFrame, width: int, now: list[list[int]], old: list[list[int]] | None = None) -> DataFrame:
    """vectors (vec_id, x) with cluster, upper and lower for the centroids ``now``; with those known for ``old``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, was = Centroids(now), Centroids(old) if old else None
        for b in batches:
            x = matrix(b, new, width)
            known = [b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower")] if was else []
            cluster, _, upper, lower = new.assign(x, *known, was) if was else new.all(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int64()), pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x array<long>, cluster long, upper double, lower double")


def sums(vectors: DataFrame, width: int, now: list[list[int]], old: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, componentwise sum)} for the centroids ``now``: a partial sum of each task, then a row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, was = Centroids(now), Centroids(old)
        n, total = np.zeros(len(now), np.int64), np.zeros((len(now), width), object)
        for b in batches:
            x = matrix(b, new, width)
            cluster = new.assign(x, *[b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower")], was)[0]
            for a in np.unique(cluster):
                n[a] += (cluster == a).sum()
                total[a] += x[cluster == a].sum(0)
        rows = np.flatnonzero(n)
        decimal = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n[rows], pa.int64()), pa.array([[int(s) for s in total[a]] for a in rows], decimal)], ["cluster", "n", "sum"])

    partial = vectors.select("x", "cluster", "upper", "lower").mapInArrow(run, "cluster long, n long, sum array<decimal(38,0)>")
    found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sum", F.lit(k))).alias(f"s{k}") for k in range(width)]).collect()
    return {r.cluster: (r.n, [int(r[f"s{k}"]) for k in range(width)]) for r in found}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with exactly ``width`` components.

    Components become floor(scale * x).  Centroids start as the k vectors of least sha256 of ``<seed>:<vec_id>``; in each
    round vectors go to the nearest centroid (the first of equals), and centroids to the floor of the mean; empty ones stay.

    Rows whose vector is null, has another length, or holds a null, NaN or infinite component are left out; so an empty
    table, or one of only such rows, gives no rows.  Repeated rows and ids count each; of equal hashes the smaller vector
    comes first, a null id comes last.  Fewer than k vectors make fewer centroids, equal ones share theirs (the first).
    Squared distances and inertias that don't fit in a long are an error.  Other columns aren't read, whatever their names.
    The driver holds the k centroids, and a task k partial sums.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = f"size(v) = {int(width)} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = rows.where(good).select("vec_id", F.expr(f"transform(v, x -> floor({float(scale)}D * x))").alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    now = [list(r.x) for r in start]
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not now:
        none = ("cast(null as int) cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
        return rows.selectExpr("vec_id", *none).where("false")
    old, state = now, stored(bounded(rows, width, now), "clusters")
    for done in range(1, rounds + 1):
        new = list(now)
        for a, (n, total) in sums(state, width, now, old).items():
            new[a] = [s // n for s in total]
        if done % REFRESH == 0:
            old, state = now, stored(bounded(state, width, now, old), "clusters")
        now = new

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, was = Centroids(now), Centroids(old)
        for b in batches:
            x = matrix(b, new, width)
            at, d2, *_ = new.assign(x, *[b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower")], was)
            for a in np.unique(at):
                here = np.flatnonzero((at == a) & (d2 < 0))
                d2[here] = squared(x[here], new.at[a])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at, pa.int32()), pa.array(d2.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    placed = cut(state.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"))
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).toPandas()  # k rows
    digests = pd.DataFrame({"cluster": pd.Series(each.cluster, dtype="int32"), "s": each.s.astype(object), "centroid": [",".join(map(str, now[a])) for a in each.cluster]})
    told = placed.sparkSession.createDataFrame([(int(a), int(s), int(each.s.sum()), c) for a, s, c in digests.itertuples(index=False)], "cluster int, cluster_inertia long, inertia long, centroid string")
    told = told.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
