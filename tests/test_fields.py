"""Expansions, the adaptive tree, and spatial operators on points off the unit box, against plain sums."""

import math

import numpy as np
import pandas as pd
import pytest

from quadrille.functions.taylor import Coulomb, Expansion, Log, Matern, direct
from quadrille.operators import fields, hierarchy, spatial


def frame(spark, p, axes, q=None):
    q = np.ones(len(p)) if q is None else q
    return spark.createDataFrame(pd.DataFrame({"id": range(len(p)), **dict(zip(axes, np.asarray(p, float).T, strict=True)), "q": q}))


def crowded(n=900, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    spread = rng.random((n // 4, dims)) * 9 - 5
    return np.concatenate([spread, *[c + 1e-5 * rng.random((n // 4, dims)) for c in (-3.0, 0.7, 2.5)]])


@pytest.mark.parametrize("kernel", [Coulomb(), Log(), Matern(1.5), Matern(2.5, 0.7)])
def test_terms_and_derivatives(kernel):
    rng, step = np.random.default_rng(0), 1e-6
    d = rng.normal(size=(20, 3))
    r2 = (d * d).sum(1)
    got = kernel.terms(r2, 4)
    for m in range(4):
        slope = (kernel.terms(r2 * (1 + step), 4)[m] - kernel.terms(r2 * (1 - step), 4)[m]) / (step * r2)  # 2 d/dr^2 = 1/r d/dr
        assert np.allclose(got[m + 1], slope, rtol=1e-5)
    e = Expansion(3, 4)
    grown = e.derivatives(kernel, d)
    for k in ((1, 0, 0), (1, 1, 0), (2, 0, 1), (0, 0, 3)):
        axis = next(a for a in range(3) if k[a])
        low, ahead, behind = e.at[e.less(k, axis)], d.copy(), d.copy()
        ahead[:, axis] += step
        behind[:, axis] -= step
        slope = (e.derivatives(kernel, ahead)[:, low] - e.derivatives(kernel, behind)[:, low]) / (2 * step)
        assert np.allclose(grown[:, e.at[k]], slope, rtol=1e-4, atol=1e-4)


def test_expansions_move():
    rng, e, kernel = np.random.default_rng(1), Expansion(3, 8), Coulomb()
    p, q, t = rng.random((30, 3)) - 0.5, rng.normal(size=30), rng.random((5, 3)) - 0.5 + [6, 1, -2]
    want = direct(kernel, t, p, q)
    m = (q @ e.powers(p))[None]
    moved = e.raised(m, np.array([[0.0, 0.0, 0.0]]) - [[0.3, -0.1, 0.2]])
    assert np.allclose(moved, q @ e.powers(p - [0.3, -0.1, 0.2]))
    local = e.met(moved, kernel, np.array([[6.0, 1.0, -2.0]]) - [[0.3, -0.1, 0.2]])
    assert np.allclose(e.value(local[0], t - [6, 1, -2]), want, rtol=1e-4, atol=1e-5)
    near = e.lowered(local, np.array([[0.1, 0.1, 0.1]]))
    assert np.allclose(e.value(near[0], t - [6.1, 1.1, -1.9]), e.value(local[0], t - [6, 1, -2]))


def test_leaves_of_crowded_points(spark):
    p = crowded()
    at, *_ = fields.placed(frame(spark, np.concatenate([p, p[:50]]), "xyz"), ["x", "y", "z"])
    got = fields.with_leaves(at, ["x", "y", "z"], 20).toPandas()
    assert len(got) == len(p)
    cells = lambda level: [tuple(int(r[f"k{a}"]) >> (fields.DEPTH - level) for a in "xyz") for r in got.to_dict("records")]
    want = np.full(len(got), -1)
    for level in range(31):
        here = cells(level)
        size = {c: here.count(c) for c in set(here)}
        want = np.where((want < 0) & np.array([size[c] < 20 for c in here]), level, want)
    assert (got.level == want).all() and want.max() > 15


@pytest.mark.parametrize(("dims", "kernel"), [(3, Coulomb()), (2, Log())])
def test_fields_and_forces_of_crowded_points(spark, dims, kernel):
    axes = "xyz"[:dims]
    p, rng = crowded(400, dims), np.random.default_rng(3)
    p = np.concatenate([p, p[-40:]])  # repeated places
    q = rng.uniform(0.5, 1.5, len(p))
    got = fields.fields(frame(spark, p, axes, q), list(axes), kernel, ncrit=16).toPandas().sort_values("id")
    want = direct(kernel, p, p, q)
    assert np.allclose(got.u, want[:, 0], rtol=5e-3)
    off, size = got[[f"g{a}" for a in axes]].to_numpy() - want[:, 1:], np.linalg.norm(want[:, 1:], axis=1)
    assert np.linalg.norm(off) < 1e-3 * np.linalg.norm(size) and np.median(np.linalg.norm(off, axis=1) / size) < 1e-3


def test_near_pairs_grow_with_the_points(spark):
    def met(n):
        tree = fields.Tree(frame(spark, crowded(n, 2), "xy"), ["x", "y"], 16, 2)
        sizes = {r.cell: len(r.points) for r in tree.blocks.collect()}
        assert max(sizes.values()) < 16
        return sum(sizes[r.t] * sizes[r.s] for r in tree.walk(0.6)[1].collect())

    few, many = met(500), met(2000)
    assert many < 6 * few < 6 * 500 * 500 / 4


def test_odd_points(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0), (3, 3.0, 4.0, None), (4, None, 0.0, 1.0), (5, math.nan, 0.0, 1.0), (6, math.inf, 1.0, 1.0), (7, -3.0, -4.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, q double")
    got = {r.id: r for r in fields.fields(df, ["x", "y"]).collect()}
    assert len(got) == 7 and got[1].u == got[2].u == 1.0 and abs(got[3].u - 1.1) < 1e-12 and got[4].u is got[5].u is got[6].u is None
    assert abs(got[7].gx - 3 * 3 / 125) < 1e-12 and fields.fields(df.where("false"), ["x", "y"]).collect() == []
    alone = fields.fields(df.where("id = 1"), ["x", "y"], Matern(1.5)).collect()
    assert [(r.u, r.gx) for r in alone] == [(1.0, 0.0)]


def nearest(rows, k):
    return sorted(((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]), a[0], b[0]) for a in rows for b in rows if a[0] < b[0])[:k]


def test_closest_pairs_anywhere(spark):
    rng = np.random.default_rng(4)
    crowd = [(k, *x) for k, x in enumerate(crowded(240, 2).tolist())]
    far = [(0, -1e6, 0.0), (1, 1e6, 5.0), (2, 1e6, 15.0)]
    repeated = [(k, float(rng.integers(-3, 3)), float(rng.integers(-3, 3))) for k in range(150)]
    hot = [(k, 7.5, -2.0) if k % 3 else (k, float(k), 1.0) for k in range(200)]
    line = [(k, float(k * k), 0.0) for k in range(40)]
    for rows, k in ((crowd, 300), (far, 3), (far, 2), (repeated, 100), (repeated, 5000), (repeated, 11175), (hot, 40), (hot, 12000), (line, 30), ([(1, 2.0, 2.0)], 5), ([(1, 2.0, 2.0), (2, 2.0, 2.0)], 5)):
        df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, x double, y double")
        got = [(r.dist2, r.i, r.j) for r in spatial.closest_pairs(df, k).orderBy("rank").collect()]
        assert got == nearest(rows, k)


def test_grid_pairs_of_any_radius(spark):
    rows = [(k, *x) for k, x in enumerate((crowded(160, 2) * 3).tolist())] + [(900, 0.0, 0.0), (901, 0.0, 2.5), (902, -1e9, 1.0), (903, -1e9, 3.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for radius in (1e-5, 0.3, 1.0, 3.0, 100.0):
        want = {a[0]: sum((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < radius**2 for b in rows) for a in rows}
        assert {r.id: r.n for r in spatial.radius_count(df, radius).collect()} == want


def test_hierarchies_off_the_unit_box(spark):
    rng = np.random.default_rng(6)
    p = rng.random((400, 2)) * [30, 50] - [7, 20]
    p[:20] = p[20:40]
    df = frame(spark, p, "xy")
    coulomb, log = direct(Coulomb(), p, p, np.ones(400))[:, 0], direct(Log(), p, p, np.ones(400))[:, 0]
    for got, want, bound in ((hierarchy.multilevel(df, 3), coulomb, 0.1), (hierarchy.single_level(df, 2), coulomb, 0.1), (hierarchy.treecode(df, 3)[0], coulomb, 0.01), (hierarchy.complex_multipole(df, 3), log, 1e-3)):
        u = got.toPandas().sort_values("id").u.to_numpy()
        assert np.linalg.norm(u - want) < bound * np.linalg.norm(want)
