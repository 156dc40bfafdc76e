"""Ranks, selection, bisection by histograms, blocked products and long transforms against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import fits, linear, ordering, runs
from quadrille.sources import files


def test_no_range_holds_much_more_than_its_share(spark):
    n = 40000
    frequent = spark.range(n).select("id", F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 100).alias("lead"), F.col("id").cast("string").alias("tie"))
    one = spark.range(n).select("id", F.lit(7).alias("lead"), F.lit("x").alias("tie"))
    skewed = spark.range(n).select("id", F.exp(F.col("id") / 2000.0).alias("lead"), F.lit("x").alias("tie"))
    for df in (frequent, one, skewed):
        sizes = [r["count"] for r in ordering.with_key_range(df, ["lead", "tie"], 16).groupBy("__range").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * n / 16
    got = ordering.ranked(frequent, F.col("lead"), ["tie"]).toPandas().sort_values("pos")
    assert got.pos.tolist() == list(range(n)) and list(zip(got.lead, got.tie, strict=True)) == sorted(zip(got.lead, got.tie, strict=True))


def test_strings_that_share_a_beginning(spark):
    words = [f"https://www.example.com/{k * 7919 % 1000:04d}" for k in range(1000)] + ["", "é", "https"]
    got = files.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w").orderBy("index").collect()
    assert [r.w for r in got] == sorted(words, key=lambda w: w.encode()) and [r["index"] for r in got] == list(range(1003))


def test_runs_in_groups(spark):
    rows = [(g, k, float(k * k % 11)) for g, n in {"a": 900, "b": 3, None: 5}.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    assert Counter(r.g for r in runs.strided(df, "g", "k", 10).collect()) == {"a": 10, "b": 3, None: 5}
    got = {(r.g, r.k): r for r in runs.indexed(df, "g", "k", "v").collect()}
    assert len(got) == 908 and all(r.idx == k and r.before == (None if k == 0 else float((k - 1) ** 2 % 11)) for (_, k), r in got.items())


@pytest.mark.parametrize("few", [4096, 8])
def test_medians_by_counting(spark, few, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "ACCURACY", 64)
    monkeypatch.setattr(ordering, "SLICES", 16)
    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=3001).tolist(), "wide": (10.0 ** rng.uniform(-300, 300, 2000)).tolist(), "ties": [1.0] * 1500 + [2.0] * 1499, "odd": [None] * 5 + [float("-inf"), float("inf"), float("nan"), 1.0], "none": [None] * 3, "one": [4.0], None: rng.integers(0, 40, 900).astype(float).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    order = lambda v: (v is not None, v != v if v is not None else False, v if v is not None else 0)
    want = {g: (len(v) // 2, sorted(v, key=order)[len(v) // 2]) for g, v in groups.items()}
    assert {r.g: (r.pos, r["median"]) for r in ordering.median(df, "g", "v").collect()} == want


def test_parts_of_equal_weight(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(3000, 2)) * [500, 1] - 7e4, [[1e5, 0.0]]])
    rows = [(k, *map(float, x), float(k % 3)) for k, x in enumerate(p)] + [(9999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double")
    for ranks, weight in ((5, None), (8, "w")):
        got, planes = ordering.refined_bisect(df, ["x", "y"], ranks, weight, refinements=6)
        shares = {r.part: r.w for r in got.groupBy("part").agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w")).collect()}
        whole = sum(shares.values())
        assert sorted(shares) == list(range(ranks)) and all(abs(s - whole / ranks) < 0.02 * whole / ranks + 4 for s in shares.values())
        assert got.count() == len(rows) and len(planes) == ranks - 1
    assert {r.part for r in ordering.refined_bisect(df.where("id < 2"), ["x", "y"], 1)[0].collect()} == {0}


def test_product_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(linear, "TILE", 8)
    monkeypatch.setattr(linear, "HELD", 2)
    rng = np.random.default_rng(2)
    a, b, c = ({(int(i), int(j)): float(v) for i, j, v in zip(rng.integers(-9, 30, n), rng.integers(-9, 30, n), rng.normal(size=n), strict=True)} for n in (300, 200, 50))
    frame = lambda m, names: spark.createDataFrame([(*k, v) for k, v in m.items()], f"{names[0]} long, {names[1]} long, v double")
    left, right, third = frame(a, "ik"), frame(b, "kj"), frame(c, "ij")
    want: dict = {}
    for (i, k), x in a.items():
        for (k2, j), y in b.items():
            if k == k2:
                want[i, j] = want.get((i, j), 0) + 2 * x * y
    got = {(r.i, r.j): r.v for r in linear.tiled_product(left, right, 2.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for k, v in c.items():
        want[k] = want.get(k, 0) - 0.5 * v
    got = {(r.i, r.j): r.v for r in linear.tiled_product(left.union(left.limit(0)), right, 2.0, -0.5, third).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert linear.tiled_product(left.where("false"), right).collect() == []


@pytest.mark.parametrize("n", [1, 12, 360, 397, 1024])
def test_long_transforms(spark, n, monkeypatch):
    monkeypatch.setattr(linear, "WHOLE", 64)
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    x[1::5] = 0
    rows = [(k, float(v.real), float(v.imag)) for k, v in enumerate(x) if v]
    got = linear.long_fft(spark.createDataFrame(rows, "t long, re double, im double"), n).toPandas().sort_values("k")
    assert got.k.tolist() == list(range(n)) and np.allclose(got.re + 1j * got.im, np.fft.fft(x), atol=1e-8)


def test_bounded_minimum_settles_or_says_so():
    def valley(x):
        return 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    x, value, settled, _ = fits.bounded_minimum(valley, [-1.2, 1], [-5, -5], [5, 5])
    assert settled and value < 1e-10 and np.allclose(x, 1, atol=1e-4)
    x, value, settled, _ = fits.bounded_minimum(valley, [-1.2, 1], [-5, -5], [0.5, 5])
    assert settled and np.allclose(x, [0.5, 0.25], atol=1e-4)
    assert not fits.bounded_minimum(valley, [-1.2, 1], [-5, -5], [5, 5], rounds=3)[2]
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(8, 8)), rng.normal(size=8)
    a = a @ a.T + np.eye(8) * 0.01
    x, _, settled, _ = fits.bounded_minimum(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(8), np.full(8, -0.3), np.full(8, 0.3))
    assert settled and np.abs(np.clip(x - (a @ x - b), -0.3, 0.3) - x).max() < 1e-5


def test_empty_tiles_meet_by_entries(spark, monkeypatch):
    """Each entry alone in its tile was a dense tile of its own."""
    dense, tiles = [], linear.tiles

    def counted(entries, row, column):
        out = tiles(entries, row, column)
        dense.append(out.count())
        return out

    monkeypatch.setattr(linear, "tiles", counted)
    a = spark.range(200).selectExpr("id * 1000 AS i", "id * 700 AS k", "1.5D AS v").unionByName(spark.range(600).selectExpr("id % 2 AS i", "id DIV 2 AS k", "1.0D AS v"))
    b = spark.range(200).selectExpr("id * 700 AS k", "id % 7 AS j", "2.0D AS v")
    got = {(r.i, r.j): r.v for r in linear.tiled_product(a, b, 2.0).collect()}
    want = {(k * 1000, k % 7): 6.0 for k in range(200)}
    want[0, 0] += 4.0
    want[1, 0] = 4.0
    assert got == want and dense[0] == 1
