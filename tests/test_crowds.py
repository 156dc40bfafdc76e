"""Sums over all pairs of crowded points: cells that are open against plain sums."""

import math

import numpy as np
import pandas as pd

from quadrille.functions.taylor import Coulomb, Log, direct
from quadrille.operators import crowds, fields
from quadrille.plans import catalogue
from quadrille.plans import fields as plans


def crowded(spark, n, dims):
    rng = np.random.default_rng(dims)
    p = np.concatenate([rng.random((n // 3, dims)) * 9 - 5, *[c + 1e-5 * rng.random((n // 3, dims)) for c in (-3.0, 0.7)]])
    p[:10] = p[10:20]  # repeated places
    q = rng.uniform(0.5, 1.5, len(p))
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), **dict(zip("xyz", p.T, strict=False)), "q": q}))
    return df, p, q


def sizes(p, q):
    r2 = ((p[:, None] - p[None]) ** 2).sum(2)
    return np.where(r2 > 0, 1 / np.where(r2 > 0, r2, 1), 0) @ q


def test_sums_of_crowded_points(spark):
    """Cells of one size held a whole crowd, all of whose pairs met one by one."""
    df, p, q = crowded(spark, 450, 3)
    names = ["exact", "size", "ex", "ey", "ez"]
    got = crowds.crowd_sums(df, list("xyz"), plans.COULOMB_FORCE, plans._coulomb_terms, [1e-15, 1e-8], names, few=0, ncrit=60).toPandas().sort_values("id")
    want, size = direct(Coulomb(), p, p, q), sizes(p, q)
    assert len(got) == len(p) and np.allclose(got.exact, want[:, 0], rtol=1e-10) and np.allclose(got["size"], size, rtol=1e-5)
    assert (np.linalg.norm(got[names[2:]].to_numpy() - want[:, 1:], axis=1) < 1e-7 * size).all()


def test_fields_of_crowded_points(spark):
    for dims, kernel, theta in ((3, Coulomb(), 0.3), (2, Log(), 0.6)):
        axes = list("xyz"[:dims])
        df, p, q = crowded(spark, 450, dims)
        got = crowds.crowd_fields(df, axes, kernel, theta=theta, ncrit=20).toPandas().sort_values("id")
        want = direct(kernel, p, p, q)
        off = np.linalg.norm(got[[f"g{a}" for a in axes]].to_numpy() - want[:, 1:], axis=1)
        assert np.allclose(got.u, want[:, 0], rtol=5e-3) and (off < 5e-3 * (sizes(p, q) if dims == 3 else np.linalg.norm(want[:, 1:], axis=1).max())).all()


def test_odd_points_in_crowds(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0), (3, 3.0, 4.0, None), (4, None, 0.0, 1.0), (5, math.nan, 0.0, 1.0), (6, math.inf, 1.0, 1.0), (7, -3.0, -4.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, q double")
    got = {r.id: r for r in crowds.crowd_fields(df, ["x", "y"]).collect()}
    assert len(got) == 7 and got[1].u == got[2].u == 1.0 and abs(got[3].u - 1.1) < 1e-12 and got[4].u is got[5].u is got[6].u is None
    assert crowds.crowd_fields(df.where("false"), ["x", "y"]).collect() == []


def test_the_query_walks_no_pairs_of_cells(spark, tiny, monkeypatch):
    """Each pair of cells was a row with a row's moments: 152 s at sf0.1."""

    def none(*a, **k):
        raise AssertionError("pairs of cells as rows")

    monkeypatch.setattr(fields.Tree, "walk", none)
    assert catalogue.QUERIES["crowded_field_bound"](spark, tiny).where("within and force_within").count() == 200
