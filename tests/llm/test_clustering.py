import hashlib
import math

import duckdb
import numpy as np
import pytest

from quadrille.llm import clustering
from quadrille.llm import queries as Q
from quadrille.llm.clustering import Centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", r[1]))[:k]
    now = [x for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in set(at):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            now[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [near(x) for _, x in kept]
    total = {j: sum(d for d, a in last if a == j) for _, j in last}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_every_distance(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    v = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 64)) * 0.2, np.round(rng.normal(size=(50, 64)))])
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    assert got(clustering.cluster(df)) == plain(rows)


def test_few_vectors_ties_and_repeats(spark):
    one, two = [0.0] * 64, [1.0] * 64
    rows = [(1, one), (2, one), (2, one), (3, two), (None, two), (4, [0.5] * 64), (5, [0.5] * 64), (6, [1e6] + [0.0] * 63), (7, None), (8, []), (9, [1.0] * 63), (10, [math.nan] + one[1:]), (11, [math.inf] + one[1:]), (12, [None, *one[1:]])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for k in (1, 3, 8, 20):
        assert got(clustering.cluster(df, k=k, rounds=3)) == plain(rows, k, 3)
    assert clustering.cluster(df.where("vec_id > 6")).collect() == []
    assert clustering.cluster(df.where("vec_id = 1"), rounds=0).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_bounds_skip_scans_but_change_nothing(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (400, 3)) if seed % 2 else rng.integers(-2000, 2000, (400, 16))
    at = x[:12].tolist()
    old = Centroids(at)
    cluster, d2, upper, lower = old.all(x)
    skipped = 0
    for _ in range(6):
        new = Centroids((np.array(at) + rng.integers(-2, 3, (12, x.shape[1]))).tolist())
        cluster, d2, upper, lower = new.assign(x, cluster, upper, lower, old)
        want = np.stack([((x - c) ** 2).sum(1) for c in new.at])
        assert (cluster == want.argmin(0)).all() and (d2[d2 >= 0] == want.min(0)[d2 >= 0]).all()
        skipped += (d2 < 0).sum()
        at, old = new.at.tolist(), new
    assert seed % 2 or skipped > 400


def test_query_against_its_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.sql(f"SELECT {cols} FROM ({Q.ORACLES['op11_exponion_clustering']})").fetchall()
    assert got(Q.QUERIES["op11_exponion_clustering"](spark, tiny)) == sorted(want, key=repr) and want
