import math

import numpy as np

from quadrille.llm import embedding
from quadrille.llm.embedding import near_duplicates


def plain(rows, least=0.9):
    def cos(a, b):
        if any(v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) for v in (a, b)):
            return 0
        n = max(len(a), len(b))
        a, b = (np.array(list(v) + [0.0] * (n - len(v))) for v in (a, b))
        return a @ b / math.sqrt((a @ a) * (b @ b))

    n = len(rows)
    link = [[i != j and cos(rows[i][1], rows[j][1]) >= least for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in range(n) if link[i][j])])
    ids = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], sum(link[i]), ids[root[i]], rows[i][0] == ids[root[i]]) for i in range(n)), key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 40)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 64))
    v = np.concatenate([centres[rng.integers(0, 12, 120)] + rng.normal(size=(120, 64)) * rng.uniform(0.1, 0.6, (120, 1)), rng.normal(size=(60, 64))])
    rows = [(int(k), [float(y) for y in x]) for k, x in zip(rng.permutation(len(v)), v, strict=True)]
    rows += [(500, rows[0][1]), (501, [2 * x for x in rows[0][1]]), (502, [-x for x in rows[0][1]])]
    assert got(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == plain(rows)


def test_edge_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, one), (2, one), (2, one), (None, one), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, None, 2.0]), (8, []), (9, [1.0, 2.0, 3.0, 0.1]), (10, [1e200, 2e200, 3e200]), (11, [1e-200, 2e-200, 3e-200]), (12, [-3.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    big = [(i, [x * 1e-200 for x in v] if i == 10 else [x * 1e200 for x in v] if i == 11 else v) for i, v in rows]
    assert got(near_duplicates(df)) == plain(big)
    assert near_duplicates(spark.createDataFrame([], df.schema)).collect() == []
    assert got(near_duplicates(df.where("vec_id = 3"))) == [(3, 0, 3, True)]


def test_dense_groups_take_the_other_path():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.3
    x = embedding.unit(x)
    basis = embedding.Basis(x, 4)
    pairs = {(i, j) for a, b in embedding.close_pairs(x, x, basis.axes, 0.9, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert pairs == set(zip(i.tolist(), j.tolist(), strict=True)) and len(pairs) > 1000


def test_one_hot_vector(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(3000)] + [(k, [float(k), 1.0, -2.0]) for k in range(3000, 3010)]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("vec_id < 3000")
    assert out.where("n_links = 2999 and component_id = 0").count() == 3000


def test_large_tiles_are_dealt_in_chunks(spark, tiny, monkeypatch):
    import quadrille.llm.embedding as E

    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    want = sorted(map(tuple, near_duplicates(df, 0.25).collect()))
    monkeypatch.setattr(E, "TILE", 40)
    monkeypatch.setattr(E, "TILES", 4)
    assert sorted(map(tuple, near_duplicates(df, 0.25).collect())) == want and sum(r[1] for r in want)


def test_every_step_prunes_or_keeps_right():
    from quadrille.llm.embedding import close_pairs, unit

    rng = np.random.default_rng(5)
    for spread in (0.01, 0.3, 3.0):  # nearly all pairs, some, none
        x = unit(rng.normal(size=40)[None] + spread * rng.normal(size=(300, 40)))
        basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        got = {(i, j) for a, b in close_pairs(x, x, basis, 0.9, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))
        got = {(i, j) for a, b in close_pairs(x[:120], x[120:], basis, 0.9, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.nonzero(x[:120] @ x[120:].T >= 0.9)
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))
