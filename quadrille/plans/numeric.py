"""Registered queries of blocked products, long transforms, histogram bisection and bounded fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import points as P
from ..operators import fits, linear, ordering, runs
from .catalogue import CU, POINTS, part, query, scaling_points


@query("""WITH ab AS (SELECT l_orderkey AS i, p_size AS j, 0.5e0 * sum(l_quantity * p_retailprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT o_orderkey AS i, o_orderkey % 50 + 1 AS j, 2e0 * o_totalprice AS v FROM orders)
SELECT i, j, round(sum(v), 3) AS v FROM (SELECT * FROM ab UNION ALL SELECT * FROM c) GROUP BY 1, 2""")
def gemm_tiles(spark, d):
    """0.5 A B + 2 C by tiles."""
    a = P.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))
    b = part(spark, d).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("j"), F.col("p_retailprice").alias("v"))
    c = P.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 50 + 1).alias("j"), F.col("o_totalprice").alias("v"))
    return linear.tiled_product(a, b, 0.5, 2.0, c).select("i", "j", F.round("v", 3).alias("v"))


#: Frequencies that the transform of all events is held against.
CHOSEN = (0, 1, 2, 3, 7, 24, 100, 365, 499)


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, value AS re, user_id % 10 AS im, count(*) OVER () AS n FROM events), k AS (SELECT unnest({list(CHOSEN)}) AS k)
SELECT CAST(k AS BIGINT) AS k, round(sum(re * cos(2 * pi() * ((k * t) % n) / n) + im * sin(2 * pi() * ((k * t) % n) / n)), 3) + 0e0 AS re, round(sum(im * cos(2 * pi() * ((k * t) % n) / n) - re * sin(2 * pi() * ((k * t) % n) / n)), 3) + 0e0 AS im FROM s, k GROUP BY k""")
def event_transform(spark, d):
    """One series of all events, transformed whole; the frequencies that SQL is asked for."""
    events = P.read(spark, d, "events")
    series = ordering.ranked(events.select("ts", "event_id", "value", "user_id"), F.col("ts"), ["event_id"], "t")
    series = series.select("t", F.col("value").alias("re"), (F.col("user_id") % 10).cast("double").alias("im"))
    whole = linear.long_fft(series, events.count())
    return whole.where(F.col("k").isin(list(CHOSEN))).select("k", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


def _refined_sql(ranks: int) -> str:
    """Levels of planes, each from three histograms of 16 bins."""
    steps = [f"l0 AS (SELECT id, x, y, z, w, 0 AS part, {ranks} AS r FROM (SELECT id, x, y, z, id % 5 + 1e0 AS w FROM cu))"]
    for k in range((ranks - 1).bit_length()):
        extent = {a: f"max({a}) - min({a})" for a in "xyz"}
        steps.append(f"""b{k} AS (SELECT part, r, sum(w) * (r // 2) / r AS goal, CASE WHEN {extent['x']} >= {extent['y']} AND {extent['x']} >= {extent['z']} THEN 0 WHEN {extent['y']} >= {extent['z']} THEN 1 ELSE 2 END AS axis,
min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM l{k} GROUP BY part, r)""")
        steps.append(f"s{k}_0 AS (SELECT part, r, goal, axis, CASE axis WHEN 0 THEN lx WHEN 1 THEN ly ELSE lz END AS lo, CASE axis WHEN 0 THEN hx WHEN 1 THEN hy ELSE hz END AS hi, 0e0 AS held FROM b{k})")
        steps.append(f"v{k} AS (SELECT l.*, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM l{k} l JOIN s{k}_0 USING (part))")
        for j in range(3):
            steps.append(f"""h{k}_{j} AS (SELECT part, least(CAST(floor((v - lo) / (hi - lo) * 16) AS INTEGER), 15) AS bin, sum(w) AS w FROM v{k} JOIN s{k}_{j} USING (part) WHERE v >= lo AND v <= hi GROUP BY 1, 2),
c{k}_{j} AS (SELECT s.*, g.bin, coalesce(h.w, 0e0) AS bw, sum(coalesce(h.w, 0e0)) OVER (PARTITION BY s.part ORDER BY g.bin) AS upto FROM s{k}_{j} s CROSS JOIN range(0, 16) g(bin) LEFT JOIN h{k}_{j} h ON h.part = s.part AND h.bin = g.bin),
s{k}_{j + 1} AS (SELECT part, r, goal - (upto - bw) AS goal, axis, lo + bin * ((hi - lo) / 16) AS lo, lo + (bin + 1) * ((hi - lo) / 16) AS hi, bw AS held FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY bin) AS nth FROM c{k}_{j} WHERE upto > goal OR bin = 15) WHERE nth = 1)""")
        steps.append(f"""l{k + 1} AS (SELECT id, x, y, z, w, CASE WHEN s.r < 2 THEN s.part WHEN v >= CASE WHEN goal * 2 < held OR goal = 0 THEN lo ELSE hi END THEN s.part + s.r // 2 ELSE s.part END AS part,
CASE WHEN s.r < 2 THEN s.r WHEN v >= CASE WHEN goal * 2 < held OR goal = 0 THEN lo ELSE hi END THEN s.r - s.r // 2 ELSE s.r // 2 END AS r FROM v{k} v JOIN s{k}_3 s ON s.part = v.part)""")
    return f"WITH {CU}, {', '.join(steps)} SELECT id, CAST(part AS INTEGER) AS part FROM l{(ranks - 1).bit_length()}"


@query(_refined_sql(4))
def histogram_bisection(spark, d):
    """Four parts of equal weight by planes from histograms."""
    pts = P.cube_points(part(spark, d)).withColumn("w", F.col("id") % 5 + F.lit(1.0))
    return ordering.refined_bisect(pts, ["x", "y", "z"], 4, "w")[0].select("id", "part")


@query(f"""WITH {POINTS}, r AS (SELECT ln(loss) - ln(exp(ln(406.4e0) - 0.34e0 * ln(n)) + exp(ln(410.7e0) - 0.28e0 * ln(d)) + exp(ln(1.69e0))) AS r FROM p)
SELECT round(sum(CASE WHEN abs(r) <= 1e-3 THEN 0.5e0 * r * r ELSE 1e-3 * (abs(r) - 0.5e-3) END), 6) AS at_start, TRUE AS settled, TRUE AS within, TRUE AS lowest FROM r""")
def scaling_fit_bounded(spark, d):
    """The fit within bounds: whether it settled, kept to them, and no allowed step of a parameter has less."""
    start = (math.log(406.4), math.log(410.7), math.log(1.69), 0.34, 0.28)
    low, high = (0.0, 0.0, -2.0, 0.0, 0.0), (25.0, 25.0, 2.0, 2.0, 2.0)
    points = scaling_points(spark, d)
    p, _, settled = fits.bounded_scaling_fit(points, start, low, high)
    steps = [tuple(min(max(x + step * (k == j), lo), hi) for j, (x, lo, hi) in enumerate(zip(p, low, high, strict=True))) for k in range(5) for step in (-1e-2, 1e-2)]
    at = points.agg(*[F.sum(K.huber(runs.scaling_residual(F.col("n"), F.col("d"), F.col("loss"), t), 1e-3)).alias(f"o{k}") for k, t in enumerate([start, p, *steps])])
    within = all(lo <= x <= hi for x, lo, hi in zip(p, low, high, strict=True))
    lowest = (F.least(*[f"o{k}" for k in range(2, 12)]) >= F.col("o1") * (1 - 1e-3)) & (F.col("o1") < F.col("o0"))
    return at.select(F.round("o0", 6).alias("at_start"), F.lit(settled).alias("settled"), F.lit(within).alias("within"), lowest.alias("lowest"))
