"""Embedding whitening by upper-triangle column aggregates.

Vectors become columns of integers.  One aggregation sums every dimension; another, of generated SQL expressions, sums the
centred products of every pair of dimensions on and above the diagonal.  LAPACK decomposes the covariance, and generated
expressions project each row.  The same two aggregations over the whitened columns tell how far their covariance is from
the identity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries c become floor(SCALE * c) + SHIFT; share of the largest eigenvalue under which a component has no variance.
SCALE, SHIFT, FLAT = 1024, 100000, 1e-12


def totals(columns: DataFrame, names: list[str]) -> tuple[int, list, list, list]:
    """(rows, sums, least, largest) of the columns, in one aggregation."""
    of = [f"{f}({c}) as {f}_{c}" for c in names for f in ("sum", "min", "max")]
    row = columns.selectExpr("count(*) as n", *of).first()
    return row.n, *([row[f"{f}_{c}"] for c in names] for f in ("sum", "min", "max"))


def covariance(columns: DataFrame, names: list[str], n: int, means: list[float]) -> np.ndarray:
    """Covariance, divisor n: products of centred columns, summed for every pair i <= j in one aggregation."""
    centred = columns.selectExpr(*[f"{c} - ({m!r}D) as c{k}" for k, (c, m) in enumerate(zip(names, means, strict=True))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = centred.selectExpr(*[f"sum(c{i} * c{j}) as p{i}_{j}" for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = value / n
    return out


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and leading component.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out, and don't count.  Entries c are the
    integers floor(1024 c) + 100000.  A shorter vector than the longest counts as if it ended in zeros, an empty one as
    zeros.  Repeated rows and null ids count each.  Components are those of the covariance of all rows left, by falling
    eigenvalue; there are as many as dimensions if those are fewer.  A component without variance has null in ``whitened``
    and explains 0, and doesn't count in ``identity_error``, which is null where no component varies.  deviation is null if
    it doesn't fit in a long.  Of equal eigenvalues any basis is right.  An empty table, or one of empty vectors only,
    gives no rows.  Other columns aren't read, whatever their names.  The driver holds one number for each pair of
    dimensions.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return rows.selectExpr("vec_id", "0 component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error").where("false")
    names = [f"x{k}" for k in range(width)]
    columns = rows.selectExpr("vec_id", *[f"floor({SCALE}D * coalesce(get(v, {k}), 0D)) + {SHIFT} as {x}" for k, x in enumerate(names)])
    n, total, least, most = totals(columns, names)
    means = [s / n for s in total]
    cov = covariance(columns, names, n, means)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:components]
    value, vector, trace = value[order], vector[:, order], float(np.trace(cov))
    varies = [k for k in range(len(value)) if value[k] > FLAT * max(value[0], 0)]

    reach = [max(s - n * lo, n * hi - s) for s, lo, hi in zip(total, least, most, strict=True)]
    fits = sum(r * r for r in reach) < 1 << 63  # no term can be larger; else in decimals
    term = (lambda x, s: f"({n}L * {x} - {s}L)") if fits else (lambda x, s: f"cast({n}BD * {x} - {s}BD as decimal(19,0))")
    deviation = " + ".join(f"{term(x, s)} * {term(x, s)}" for x, s in zip(names, total, strict=True))
    centred = [f"({x} - ({m!r}D))" for x, m in zip(names, means, strict=True)]
    turned = vector / np.sqrt(np.where(value > 0, value, 1))
    projected = [" + ".join(f"{c} * ({float(t)!r}D)" for c, t in zip(centred, turned[:, k], strict=True)) for k in varies]
    done = stored(columns.selectExpr("vec_id", f"try_cast({deviation} as long) as deviation", *[f"{p} as w{k}" for k, p in zip(varies, projected, strict=True)]), "whitened")

    error = None
    if varies:
        own = [f"w{k}" for k in varies]
        _, sums, _, _ = totals(done, own)
        error = float(np.abs(covariance(done, own, n, [s / n for s in sums]) - np.eye(len(own))).max())
    each = [
        F.struct(F.lit(k + 1).alias("component"), (F.col(f"w{k}") if k in varies else F.lit(None).cast("double")).alias("whitened"), F.lit(float(max(value[k], 0) / trace) if k in varies else 0.0).alias("explained"))
        for k in range(len(value))
    ]
    told = done.select("vec_id", "deviation", F.explode(F.array(*each)).alias("c"))
    return told.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
