"""Goldens, error bounds and properties of operators that no SQL stands beside."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import kernels as K
from quadrille.functions import points as P
from quadrille.functions import vectors as V
from quadrille.operators import fits, hierarchy, intervals, linear, models, ordering, runs, spatial


@pytest.fixture(scope="module")
def charges(spark, tiny):
    return P.square_points(spark.read.parquet(f"{tiny}/part.parquet")).withColumn("q", F.lit(1.0)).cache()


def direct(charges, kernel):
    pairs = spatial.all_pairs(charges, charges)
    return pairs.groupBy(F.col("idi").alias("id")).agg(F.sum(F.col("qj") * kernel(spatial.distance2(["x", "y"]))).alias("exact"))


def error(approx, exact):
    return spatial.relative_l2(approx.join(exact, "id"), "u", "exact").first().error


@pytest.mark.parametrize("level, bound", [(2, 0.06), (3, 0.06)])
def test_single_level_error(charges, level, bound):
    assert error(hierarchy.single_level(charges, level), direct(charges, K.coulomb)) < bound


def test_multilevel_and_treecode_errors(charges):
    exact = direct(charges, K.coulomb)
    assert error(hierarchy.multilevel(charges, 3), exact) < 0.06
    u, counts = hierarchy.treecode(charges, 3, 0.5)
    assert error(u, exact) < 2e-3 and {r.kind: r.n > 0 for r in counts.collect()} == {"cell": True, "near": True}


def test_complex_expansion_error(charges):
    assert error(hierarchy.complex_multipole(charges, 3, 6), direct(charges, K.log_kernel)) < 1e-3


def test_shifted_moments_are_the_parents_moments(charges):
    a = {(r.ix, r.iy): r for r in hierarchy.shift_up(hierarchy.complex_moments(charges, 3, 5), 3, 5).collect()}
    b = {(r.ix, r.iy): r for r in hierarchy.complex_moments(charges, 2, 5).collect()}
    assert a.keys() == b.keys() and all(abs(a[k][c] - b[k][c]) < 1e-9 for k in a for c in b[k].asDict() if c[0] == "M")


def test_line_expansion_error(charges):
    line = charges.select("id", "x", F.lit(1.0).alias("q"))
    pairs = spatial.all_pairs(line, line)
    exact = pairs.groupBy(F.col("idi").alias("id")).agg(F.sum(K.coulomb(spatial.distance2(["x"]))).alias("exact"))
    assert error(hierarchy.line_multipole(line, 0.0, 1.0, 5), exact) < 1e-3


def test_cube_moments_about_mass(charges):
    pts = charges.withColumn("z", F.col("x") * F.col("y"))
    m = hierarchy.cube_moments(pts, 1, about_mass=True)
    assert m.agg(F.sum("m")).first()[0] == charges.count() and not {"dx", "dy", "dz"} & set(m.columns)
    assert m.where("qxx < 0 or qyy < 0 or qzz < 0 or cx < 0 or cx > 1").count() == 0


def test_ranks_and_checksums(spark):
    from quadrille.operators.cluster import checksum, rank_hosts

    assert [(r["rank"], r["size"]) for r in rank_hosts(spark, 2).orderBy("rank").collect()] == [(0, 2), (1, 2)]
    df = spark.range(100)
    assert checksum(df).first() == checksum(df.orderBy(F.desc("id")).repartition(3)).first() != checksum(df.where("id > 0")).first()


def test_cells_add_up(charges):
    cells = hierarchy.cells_of_levels(charges, ["x", "y"], 4).groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = charges.count()
    assert {r.level: r.n for r in cells} == {k: n for k in range(5)}
    leaves = hierarchy.adaptive_leaves(charges, ["x", "y"], 16, 5)
    assert leaves.agg(F.sum("n")).first()[0] == n and leaves.where("n >= 16 and level < 5").count() == 0


def test_bisection_is_balanced(spark, tiny):
    pts = P.cube_points(spark.read.parquet(f"{tiny}/part.parquet"))
    sizes = [r["count"] for r in ordering.bisect(pts, ["x", "y", "z"], 3).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    weighted = [r["count"] for r in ordering.weighted_bisect(pts, ["x", "y", "z"], 5).groupBy("part").count().collect()]
    assert len(weighted) == 5 and sum(weighted) == 200 and max(weighted) - min(weighted) <= 2


def test_ranked_handles_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(k, 1.0 if k % 3 else float(k)) for k in range(50)], "id long, v double")
    got = {r.id: r.pos for r in ordering.ranked(df, F.col("v"), ["id"], buckets=7).collect()}
    want = {k: n for n, k in enumerate(sorted(range(50), key=lambda k: (1.0 if k % 3 else float(k), k)))}
    assert got == want
    assert ordering.ranked(df.where("id < 0"), F.col("v"), ["id"]).collect() == []


def test_rank_halving_goldens(spark):
    rows = ordering.rank_halving(spark, 7).collect()
    last = sorted((r for r in rows if r.level == 2), key=lambda r: r["rank"])
    assert [r.disp for r in last] == [r.color for r in last] == list(range(7)) and {r.cnt for r in last} == {1} and {r.key for r in last} == {0}
    assert [r.other for r in last] == [0, 1, 1, 1, 1, 1, 1]
    first = sorted((r for r in rows if r.level == 0), key=lambda r: r["rank"])
    assert [r.disp for r in first] == [0, 0, 0, 3, 3, 3, 3] and [r.key for r in first] == [0, 1, 2, 0, 1, 2, 3]


def test_closest_pairs_widens_until_enough(spark):
    pts = spark.createDataFrame([(k, (k % 10) / 10, (k // 10) / 10) for k in range(100)], "id long, x double, y double")
    got = spatial.closest_pairs(pts, 500, reach=1.0).collect()
    all_ = sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2, a.id, b.id) for a in pts.collect() for b in pts.collect() if a.id < b.id)[:500]
    assert [(r.i, r.j) for r in got] == [(i, j) for _, i, j in all_]
    assert spatial.closest_pairs(pts.limit(1), 5).collect() == []


def test_morton_round_trip_and_octants(spark):
    df = spark.range(512).select(*[(F.shiftright("id", 3 * k) % 8).alias(a) for k, a in enumerate("xyz")])
    key = P.morton3(F.col("x"), F.col("y"), F.col("z"), 3)
    back = df.withColumn("k", key).select("k", "x", "y", "z", *[P.deinterleave(F.col("k"), a, 3, 3).alias(f"{n}2") for a, n in enumerate("xyz")])
    assert back.where("x <> x2 or y <> y2 or z <> z2").count() == 0 and back.select("k").distinct().count() == 512
    assert spark.range(1).select(P.octant(*[F.lit(v) for v in (2.0, 0.0, 3.0, 1.0, 1.0, 1.0)]).alias("o")).first().o == 5
    assert [P.adaptive_level(n, 64, 3) for n in (63, 64, 64 * 8, 64 * 64)] == [0, 1, 2, 3]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0], [4.0, 5.0, 0.5])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.add(a, b), V.sub(a, b), V.mul(a, b), V.div(a, b), V.scale(a, 2.0), V.total(a), V.norm2(a), V.dot(a, b), V.least(a, b), V.greatest(a, b), V.absolute(a), V.greater(a, b), V.reciprocal_sqrt(b), V.wrap(a, 4.0), V.wrap_mask(a, 4.0)).first()
    x, y = np.array([1, -2, 3.0]), np.array([4, 5, 0.5])
    want = [x + y, x - y, x * y, x / y, 2 * x, 2.0, 14.0, -4.5, np.minimum(x, y), np.maximum(x, y), abs(x), x > y, 1 / np.sqrt(y), [1, -2, -1], 4]
    assert all(np.allclose(g, w) for g, w in zip(r, want, strict=True))


def test_matern_closed_form_and_bessel():
    r = np.array([0.0, 0.1, 1.0, 5.0])
    big = r * math.sqrt(3) / 2
    assert np.allclose(K.matern(1.5, r), (1 + big) * np.exp(-big), atol=1e-6)
    assert np.allclose(K.bessel_k(0.5, np.array([1.0, 2.0])), np.sqrt(np.pi / 2 / np.array([1.0, 2.0])) * np.exp(-np.array([1.0, 2.0])), rtol=1e-5)


def test_intervals(spark):
    t = lambda h: f"2024-01-02 {h:02d}:00:00"
    rows = [("a", t(1), t(3)), ("a", t(3), t(4)), ("a", t(6), t(9)), ("a", t(7), t(8)), ("b", t(20), t(22))]
    busy = spark.createDataFrame(rows, "cal string, s string, e string").select("cal", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    hours = lambda df: sorted((r.cal, r.s.hour, r.e.hour) for r in df.collect())
    assert hours(intervals.union(busy)) == [("a", 1, 4), ("a", 6, 9), ("b", 20, 22)]
    cals = spark.createDataFrame([("a",), ("b",), ("c",)], "cal string")
    assert hours(intervals.gaps(busy, cals, t(2), t(21))) == [("a", 4, 6), ("a", 9, 21), ("b", 2, 20), ("c", 2, 21)]


def test_interpolation_clamps_and_sorts(spark):
    curve = spark.createDataFrame([("m", 0.0, 1.0), ("m", 10.0, 3.0), ("m", 10.0, 2.0)], "k string, x double, y double")
    ask = spark.createDataFrame([("m", -5.0), ("m", 0.0), ("m", 5.0), ("m", 99.0), ("n", 1.0)], "k string, x double")
    got = {(r.k, r.x): r.y for r in runs.interpolate(ask, curve, ["k"]).collect()}
    assert got == {("m", -5.0): 1.0, ("m", 0.0): 1.0, ("m", 5.0): 2.0, ("m", 99.0): 3.0, ("n", 1.0): None}


def test_filter_documents(spark):
    df = spark.createDataFrame([("a7b", "2024-01-01", ["x"]), ("zzz", "2024-03-01", ["x"]), ("qq", "2024-01-01", [])], "name string, created string, tags array<string>").withColumn("created_at", F.col("created").cast("timestamp"))
    names = lambda f: sorted(r.name for r in runs.matching(df, f).collect())
    assert names([{}]) == ["a7b", "qq", "zzz"] and names([{"tag": "x", "before": "2024-02-01"}]) == ["a7b"] and names([{"name": "7|q"}]) == ["a7b", "qq"] and names([]) == []


def test_gradients(spark):
    rows = lambda y: spark.createDataFrame([(1.0, y), (2.0, y)], "x double, y double")
    a, b = models.mse_gradient(rows(0.0), 1.0).first(), models.mse_gradient(rows(1.0), 2.0).first()
    assert (a.loss, a.dw, b.loss, b.dw) == (2.5, 5.0, 5.0, 7.0)


def test_model_goldens(spark):
    got = {r.model: r.billions for r in models.parameter_counts(spark).collect()}
    assert got["total"] == 677.5113 and got["active"] == 32.5372 and got["dense-13"] == 72.65181 and got["dense-70"] == 463.86747 and got["dense-172"] == 1124.02326


def test_round_up(spark):
    df = spark.createDataFrame([("¥1,000,000",), ("１２３円",), ("none",), (None,), ("110000",)], "t string")
    got = [(r.amount, r.total, r.units, r.carry) for r in models.round_up(df, "t").collect()]
    assert got == [(1000000, 1100000, 4000.0, 100000), (123, 110000, 400.0, 109877), (None,) * 4, (None,) * 4, (110000, 110000, 400.0, 0)]


def test_token_labels(spark):
    df = spark.createDataFrame([(v,) for v in (500.7, 1500.0, 2500.0, 1.25e6, 3.9e6)], "t double")
    assert [r.l for r in df.select(runs.token_label(F.col("t")).alias("l")).collect()] == ["500B", "1.5T", "2T", "1.3Q", "3Q"]


def test_sigmoid_fit_recovers(spark):
    df = spark.range(500).select(F.lit("t").alias("g"), (F.col("id") / 100).alias("x")).withColumn("y", K.sigmoid(F.col("x"), 2.0, 3.0))
    r = fits.sigmoid_fit(df, "g").first()
    assert abs(r.x0 - 2) < 0.01 and abs(r.k - 3) < 0.05 and r.n == 500


def test_sigmoid_fit_sees_every_point(spark):
    """One far point mustn't change the fit of the others; groups settle apart,
    rising curves too, and points without y only count."""
    x = F.when(F.col("id") == 0, 1e6).otherwise(F.col("id") * 0.1)
    df = spark.range(4900).select(F.lit("far").alias("g"), x.alias("x")).withColumn("y", K.sigmoid(F.col("x"), 200.0, 0.02))
    near = df.where("x < 1e5").select(F.lit("near").alias("g"), "x", K.sigmoid(F.col("x"), 100.0, -0.05).alias("y"))
    odd = spark.createDataFrame([("near", 5.0, None), ("near", None, 0.5)], "g string, x double, y double")
    got = {r.g: r for r in fits.sigmoid_fit(df.unionByName(near).unionByName(odd), "g").collect()}
    assert abs(got["far"].x0 - 200) < 1e-3 and abs(got["far"].k - 0.02) < 1e-6 and got["far"].n == 4900
    assert abs(got["near"].x0 - 100) < 1e-3 and abs(got["near"].k + 0.05) < 1e-6 and got["near"].n == 4901


def test_sigmoid_fit_without_points(spark):
    df = spark.createDataFrame([("none", None, None), ("one", 3.0, 0.5)], "g string, x double, y double")
    got = {r.g: r for r in fits.sigmoid_fit(df, "g").collect()}
    assert got["none"].x0 is None and got["none"].n == 1 and got["one"].x0 == 3 and got["one"].n == 1


def test_scaling_fit_lowers_the_objective(spark):
    n, d = np.meshgrid(np.geomspace(1e9, 2e11, 8), np.geomspace(1e10, 1e13, 8))
    loss = 1.8 + 300 / n**0.33 + 500 / d**0.29
    pts = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([n.ravel(), d.ravel(), loss.ravel()])], "n double, d double, loss double").repartition(2).cache()
    start = (math.log(406.4), math.log(410.7), math.log(1.69), 0.34, 0.28)
    before = runs.scaling_objective(pts, start).first().objective
    p, after = fits.scaling_fit(pts, start)
    assert after < before / 100 and abs(math.exp(p[2]) - 1.8) < 0.05


def test_kmeans_settles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    pts = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in enumerate(x[rng.permutation(120)])], "id long, v array<double>").cache()
    out, centroids = linear.kmeans(pts, 3)
    assert len(centroids) == 3 and out.agg(F.count("*")).first()[0] == 120


def test_transforms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=16) + 1j * rng.normal(size=16)
    s = spark.createDataFrame([(0, k, float(v.real), float(v.imag)) for k, v in enumerate(x)], "g int, t int, re double, im double")
    want = np.fft.fft(x)
    for got in (linear.dft(s, 16), linear.fft(s, "g")):
        rows = sorted(got.collect(), key=lambda r: r.k)
        assert np.allclose([r.re + 1j * r.im for r in rows], want)


def test_all_pairs_includes_every_pair(spark):
    df = spark.range(37).select("id", F.lit(1.0).alias("m"))
    assert spatial.all_pairs(df, df, 5).select("idi", "idj").distinct().count() == 37 * 37


def test_grid_join_is_no_nested_loop(charges):
    plan = spatial.radius_count(charges, 0.05)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scales_look_ups_and_mean_curve(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 9.0)], "k string, v double")
    r = df.select(runs.scale(F.col("v"), F.lit(3.0), F.lit(9.0)).alias("s"), runs.in_range(F.col("v"), 3.0, 10.0).alias("i")).collect()
    assert [(x.s, x.i) for x in r] == [(0.0, False), (1.0, True)]
    assert df.select(runs.unscale(F.lit(0.5), F.lit(3.0), F.lit(9.0)).alias("u")).first().u == 6.0
    assert runs.lookup(df, df.select("k", F.lit(1).alias("w")), "k").count() == 2
    with pytest.raises(KeyError):
        runs.lookup(df, df.where("k = 'a'").select("k"), "k").count()
    fitted = spark.createDataFrame([(2.0, 1.0, 0.0, 1.0), (2.0, 1.0, 1.0, 3.0)], "x0 double, k double, low double, high double")
    assert abs(runs.mean_curve(fitted, spark.createDataFrame([(2.0,)], "x double")).first().y - 1.25) < 1e-12
    one = spark.range(1).select(runs.months(F.lit(172e9), F.lit(2e12)).alias("m"), runs.tokens(F.lit(2), F.lit(3), F.lit(4)).alias("t")).first()
    assert abs(one.m - 2600) < 1e-6 and one.t == 24


def test_dense_keys_and_bins(spark):
    df = spark.createDataFrame([(k,) for k in (9000, 5, 5, 7, 9001)], "k long")
    assert {r.k: r["index"] for r in ordering.dense_keys(df, "k").collect()} == {5: 0, 7: 1, 9000: 2, 9001: 3}
    high, low = P.two_level_bin(F.lit(0.77), 4, 5)
    assert tuple(spark.range(1).select(high, low).first()) == (3, 0)


def test_unwrap_undoes_wrap(spark):
    df = spark.createDataFrame([([0.3, -0.7, 0.6, -0.1],)], "v array<double>")
    out = df.select(V.unwrap(V.wrap(F.col("v"), 1.0), V.wrap_mask(F.col("v"), 1.0), 1.0).alias("v")).first().v
    assert np.allclose(out, [0.3, -0.7, 0.6, -0.1])


def test_shifted_cube_moments(charges):
    pts = charges.withColumn("z", F.col("x") * F.col("y"))
    key = lambda r: (r.ix, r.iy, r.iz)
    a = {key(r): r for r in hierarchy.shift_up_cube(hierarchy.cube_moments(pts, 2), 2).collect()}
    b = {key(r): r for r in hierarchy.cube_moments(pts, 1).collect()}
    assert a.keys() == b.keys() and all(abs(a[k][c] - b[k][c]) < 1e-9 for k in a for c in a[k].asDict())


def test_bessel_wronskian():
    x = np.array([0.5, 1.0, 3.0])
    w = K.bessel_i(0.5, x) * K.bessel_k(1.5, x) + K.bessel_i(1.5, x) * K.bessel_k(0.5, x)
    assert np.allclose(w, 1 / x, rtol=1e-5)


def test_ranks_of_big_and_odd_keys(spark):
    rows = [((1 << 60) + k, k % 3) for k in range(50)] + [(None, 0), (-(1 << 61), 1)]
    df = spark.createDataFrame(rows, "k long, g long")
    got = [r.k for r in ordering.ranked(df, F.col("k"), [], buckets=5).orderBy("pos").collect()]
    assert got == [None, -(1 << 61), *((1 << 60) + k for k in range(50))]
    by = {(r.g, r.k): r.pos for r in ordering.ranked(df.where("k > 0"), F.col("k"), [], buckets=3, by="g").collect()}
    assert [key for key, _ in sorted(by.items(), key=lambda x: x[1])] == sorted(by)


def test_medians_of_any_values(spark):
    rows = [(g, v) for g, values in {"a": [-5.0, 2e6, 7e9], "b": [1.0, -1e12], None: [3.0]}.items() for v in values]
    got = {(r.g, r.pos, r.median) for r in ordering.median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {("a", 1, 2e6), ("b", 1, 1.0), (None, 0, 3.0)}


def test_bisection_outside_the_unit_box(spark):
    df = spark.createDataFrame([(k, 1e6 * (k * 37 % 64) - 3e7, -float(k * 11 % 64)) for k in range(64)], "id long, x double, y double")
    rows = ordering.bisect(df, ["x", "y"], 2).collect()
    assert sorted(Counter(r.part for r in rows).items()) == [(k, 16) for k in range(4)]
    assert max(r.x for r in rows if r.part < 2) < min(r.x for r in rows if r.part > 1)
    parts = Counter(r.part for r in ordering.weighted_bisect(df, ["x", "y"], 3).collect())
    assert sorted(parts.values()) == [21, 21, 22]


def test_offsets_of_big_and_negative_keys(spark):
    keys = [-5, -5, -1, 0, 3, (1 << 55) + 1, (1 << 55) + 1, (1 << 55) + 2]
    got = {r.k: (r.n, r.offset) for r in ordering.bucket_offsets(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 2).collect()}
    assert got == {-5: (2, 0), -1: (1, 2), 0: (1, 3), 3: (1, 4), (1 << 55) + 1: (2, 5), (1 << 55) + 2: (1, 7)}


def test_all_pairs_in_many_blocks(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    assert spatial.all_pairs(df, df, blocks=3, block_rows=17).select("idi", "idj").distinct().count() == 10_000
    pairs = spatial.triangle_pairs(df, block_rows=17)
    assert pairs.where("idi >= idj").count() == 0 and pairs.select("idi", "idj").distinct().count() == pairs.count() == 4950
    assert pairs.where("xi <> idi or xj <> idj").count() == 0


def test_neutral_cells(spark):
    """Charges of both signs, some cells neutral: the tree code has centres and dipoles for them."""
    rng = random.Random(3)
    rows = [(k, rng.random(), rng.random(), rng.random(), (-1.0) ** k) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, q double")
    m = hierarchy.leaf_moments(df, 0).first()
    assert m.m == 0 and 0.4 < m.xc < 0.6 and abs(m.dx) > 0
    for axes in ("xy", "xyz"):
        at = {r[0]: r for r in rows}
        dist = lambda a, b, axes=axes: math.sqrt(sum((a["0xyz".index(c)] - b["0xyz".index(c)]) ** 2 for c in axes))
        exact = {i: sum(b[4] / dist(a, b) for b in rows if b[0] != i) for i, a in at.items()}
        got = {r.id: r.u for r in hierarchy.treecode(df, 2, 0.4, tuple(axes))[0].collect()}
        scale = math.sqrt(sum(v * v for v in exact.values()))
        assert math.sqrt(sum((got[i] - v) ** 2 for i, v in exact.items())) / scale < 0.01


def test_busy_calendar_in_many_ranges(spark):
    """One hot calendar, a null one, long intervals that cover many ranges."""
    rng = random.Random(4)
    rows = [("hot", a, a + rng.choice([1, 5, 40])) for a in (rng.randrange(5000) for _ in range(600))] + [("hot", 1000, 2500), (None, 3, 9), (None, 9, 11), ("one", 5, 6)]
    df = spark.createDataFrame(rows, "cal string, s long, e long").select("cal", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    want = []
    for cal in ("hot", None, "one"):
        last = None
        for a, b in sorted((a, b) for c, a, b in rows if c == cal):
            if last and a <= last[2]:
                last[2] = max(last[2], b)
            else:
                last = [cal, a, b]
                want.append(last)
    got = [[r.cal, r.s, r.e] for r in intervals.union(df).select("cal", F.unix_seconds("s").alias("s"), F.unix_seconds("e").alias("e")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 20


def test_runs_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [(by, k, rng.choice(["a", "a", "b", None])) for by in (1, None) for k in range(400)]
    want = {}
    for by in (1, None):
        run, last = 0, None
        for k, (_, o, key) in enumerate(r for r in rows if r[0] == by):
            run += k > 0 and key is not None and last is not None and key != last
            last = key
            want.setdefault((by, run, key), []).append(o)
    got = {(r.by, r.run, r.key): (r.n, r.first) for r in ordering.runs(spark.createDataFrame(rows, "by long, at long, key string"), "by", "at", "key").collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()}
