import math

import numpy as np

from quadrille.llm import queries as Q
from quadrille.llm import whitening
from quadrille.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, component string"


def held(df, rows, components=8):
    """The result against numpy, sign by sign."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    apart = n * x - sums
    deviation = (apart * apart).sum(1)
    d = apart.astype(float) / n
    value, vector = np.linalg.eigh(d.T @ d / n)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    got = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in df.collect())
    assert len(got) == n * len(value) and {r[2] for r in got} == {n}
    flip = None
    for k in range(len(value)):
        own = [r for r in got if r[1] == k + 1]
        want = sorted(zip([i for i, _ in kept], deviation.tolist(), (d @ vector[:, k] / math.sqrt(value[k])).tolist(), strict=True))
        assert [(r[0], r[3]) for r in own] == [w[:2] for w in want]
        flip = np.sign(own[0][4] * want[0][2])
        assert np.allclose([r[4] for r in own], [flip * w[2] for w in want], atol=1e-7)
        assert math.isclose(own[0][5], value[k] / (d * d).sum() * n, rel_tol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 12)) * np.linspace(1, 3, 12)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(200, None), (201, [math.nan] * 12), (202, [math.inf, *[0.0] * 11]), (203, [None, *[0.0] * 11]), (204, [5.0, 1.0]), (205, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    held(whiten(df), rows)
    held(whiten(df.union(df)), rows + rows)
    held(whiten(df, components=3), rows, 3)


def test_few_dimensions_and_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 2.0], "x"), (None, [5.0, 2.0], "x")], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whiten(df).collect()}
    assert len(got) == 6 and got[2, 1].whitened == 0 and abs(abs(got[1, 1].whitened) - math.sqrt(1.5)) < 1e-12 and got[1, 1].explained == 1
    assert got[1, 2].whitened is None and got[1, 2].explained == 0 and got[None, 1].identity_error < 1e-9 and got[1, 1].deviation == (3 * 2048) ** 2
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")], SCHEMA)).collect()
    assert len(same) == 4 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, None)}
    for rows in ([], [(1, None, "x")], [(1, [], "x")]):
        assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(1, [0.0]), (2, [2.0**21]), (3, [2.0**22])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {1: None, 2: 0, 3: None}


def test_query(spark, tiny):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    held(Q.QUERIES["op12_whitening"](spark, tiny), rows)
    assert whitening.SHIFT == 100000
