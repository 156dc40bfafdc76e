"""Curve fits: sums over the data in Spark, the small optimiser on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .runs import scaling_residual

#: Groups up to which the parameters of a round are broadcast to the points; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def sigmoid_fit(points: DataFrame, by: str, rounds: int = 60) -> DataFrame:
    """(by, x0, k, n): least squares of y = 1 / (1 + exp(-k (x0 - x))) for each group, by damped Gauss-Newton.

    Each round is one aggregate over all points of the groups that haven't settled; points without x or y count in n
    only. The start is the best of a weighted fit of the logits of y and of a few curves at quantiles of x, so that
    neither far points nor a rising curve lead it astray.
    """
    points = points.select(F.col(by).alias("__by"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("__by is not null")
    usable = points.where("x is not null and y is not null")
    z = points.withColumn("z", F.expr("case when x is not null and y > 0 and y < 1 then ln(y / (1 - y)) end")).withColumn("w", F.expr("case when z is not null then pow(y * (1 - y), 2) end"))
    moments = {"w0": "w", "wx": "w * x", "wz": "w * z", "wxx": "w * x * x", "wxz": "w * x * z"}
    q = F.percentile_approx(F.expr("if(y is null, null, x)"), [0.05, 0.25, 0.5, 0.75, 0.95], 1000)
    first = z.groupBy("__by").agg(F.count("*").alias("n"), q.alias("q"), F.stddev_pop("x").alias("sd"), *[F.sum(F.expr(e)).alias(c) for c, e in moments.items()])
    first = first.withColumn("scale", F.expr("if(q[4] > q[0], q[4] - q[0], greatest(sd, 1e-6))")).withColumn("lk", F.expr("-try_divide(w0 * wxz - wx * wz, w0 * wxx - wx * wx)"))
    starts = [(f"q[{i}]", f"{m} / scale") for i in range(5) for m in (-8, -2, 2, 8)] + [("try_divide(wx, w0) + try_divide(try_divide(wz, w0), lk)", "lk")]
    first = cut(first.select("__by", "n", F.array(*[F.struct(F.expr(x0).alias("x0"), F.expr(k).alias("k")) for x0, k in starts]).alias("starts")))
    few = first.count() <= BROADCAST_GROUPS
    sent = lambda df: F.broadcast(df) if few else df
    costs = usable.join(sent(first), "__by").groupBy("__by").agg(F.array(*[F.sum(F.expr(f"pow(y - 1 / (1 + exp(-starts[{i}].k * (starts[{i}].x0 - x))), 2)")) for i in range(len(starts))]).alias("costs"))
    best = F.expr("array_min(filter(zip_with(costs, starts, (c, s) -> struct(c, s.x0, s.k)), t -> t.c is not null))")
    # Accepted parameters with their cost, normal matrix (a, b; b, c) and gradient (g, h); then the ones to try.
    state = first.join(costs, "__by", "left").withColumn("best", best).select(
        "__by", "n", "best.x0", "best.k", F.lit(float("inf")).alias("cost"), *[F.lit(0.0).alias(c) for c in "abcgh"], F.lit(3e-3).alias("damp"),
        F.col("best.x0").alias("try_x0"), F.col("best.k").alias("try_k"), F.col("best").isNotNull().alias("open"),
    )
    state = cut(state)

    for _ in range(rounds):
        tried = state.where("open").select("__by", "try_x0", "try_k")
        at = usable.join(sent(tried), "__by")
        at = at.withColumn("f", 1 / (1 + F.exp(-F.col("try_k") * (F.col("try_x0") - F.col("x"))))).withColumn("s", F.expr("f * (1 - f)"))
        at = at.select("__by", F.expr("y - f").alias("r"), F.expr("s * try_k").alias("u"), F.expr("s * (try_x0 - x)").alias("v"))
        sums = at.groupBy("__by").agg(*[F.sum(F.expr(e)).alias(f"new_{c}") for c, e in {"cost": "r * r", "a": "u * u", "b": "u * v", "c": "v * v", "g": "u * r", "h": "v * r"}.items()])
        both = state.join(sums, "__by", "left").withColumn("better", F.expr("coalesce(new_cost < cost, false)"))
        kept = [F.when(F.col("better"), F.col(new)).otherwise(F.col(c)).alias(c) for c, new in [("x0", "try_x0"), ("k", "try_k"), *((c, f"new_{c}") for c in ("cost", *"abcgh"))]]
        both = both.select("__by", "n", *kept, F.expr("if(better, damp / 3, damp * 4)").alias("damp"), "open")
        both = both.withColumn("p", F.expr("a + damp * (a + 1e-12)")).withColumn("q", F.expr("c + damp * (c + 1e-12)")).withColumn("det", F.expr("1 - b * b / (p * q)"))
        both = both.withColumn("dx", F.expr("try_divide(g / p - b * h / (p * q), det)")).withColumn("dk", F.expr("try_divide(h / q - b * g / (p * q), det)"))
        settled = "damp <= 1 and abs(dx * k) <= 1e-8 and abs(dk) <= 1e-8 * abs(k) or damp > 1e9"
        both = both.select(*state.columns[:11], F.expr("x0 + dx").alias("try_x0"), F.expr("k + dk").alias("try_k"), F.expr(f"open and not coalesce({settled}, false)").alias("open"))
        state = cut(both)
        if state.where("open").isEmpty():
            break
    return state.select(F.col("__by").alias(by), "x0", "k", "n")


def scaling_fit(points: DataFrame, start: tuple[float, ...], delta: float = 1e-3, rounds: int = 100) -> tuple[tuple[float, ...], float]:
    """Five parameters of the scaling law and the objective there: each round is one aggregate of residual and slopes.

    Huber loss by iteratively reweighted Gauss-Newton (weight delta / |r| beyond delta) with a step-halving search.
    """
    points = points.select("n", "d", "loss")

    def sums(p):
        a, b, e, alpha, beta = (F.lit(float(x)) for x in p)
        t1, t2, t3 = F.exp(a - alpha * F.log("n")), F.exp(b - beta * F.log("d")), F.exp(e)
        s = t1 + t2 + t3
        j = [t1 / s, t2 / s, t3 / s, -t1 / s * F.log("n"), -t2 / s * F.log("d")]
        rows = points.select(scaling_residual(F.col("n"), F.col("d"), F.col("loss"), p).alias("r"), *[c.alias(f"j{k}") for k, c in enumerate(j)])
        size = F.abs("r")
        w = F.when(size <= delta, F.lit(1.0)).otherwise(delta / size)
        cost = F.sum(F.when(size <= delta, 0.5 * F.col("r") * F.col("r")).otherwise(delta * (size - 0.5 * delta)))
        pairs = [(x, y) for x in range(5) for y in range(x, 5)]
        row = rows.agg(cost.alias("cost"), *[F.sum(w * F.col(f"j{x}") * F.col(f"j{y}")) for x, y in pairs], *[F.sum(w * F.col(f"j{x}") * F.col("r")) for x in range(5)]).first()
        h = np.zeros((5, 5))
        for (x, y), v in zip(pairs, row[1:16], strict=True):
            h[x, y] = h[y, x] = v
        return row[0], h, np.array(row[16:])

    p = np.array(start, float)
    cost, h, g = sums(p)
    damp = 1e-3
    for _ in range(rounds):
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), g)
        c2, h2, g2 = sums(p + step)
        if c2 < cost:
            done = cost - c2 < 1e-12 * max(cost, 1)
            p, cost, h, g, damp = p + step, c2, h2, g2, damp / 4
            if done:
                break
        else:
            damp *= 6
            if damp > 1e9:
                break
    return tuple(float(x) for x in p), float(cost)


def bounded_minimum(f, start, low, high, memory: int = 8, rounds: int = 200, flat: float = 1e-7, least: float = 1e-11) -> tuple[np.ndarray, float, bool, int]:
    """(x, value, settled, evaluations): a minimum of f, which gives (value, slope), within bounds, by limited-memory curvature.

    Each round takes a direction from the last ``memory`` changes of x and slope, over the parameters that no bound holds, and
    shortens the step, cut off at the bounds, until the value falls enough.  It has settled where the slope that bounds leave
    is flat, or the last rounds brought next to nothing; else it says that it hasn't.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(start, float), low, high)
    (value, slope), calls, pairs, still = f(x), 1, [], 0
    for _ in range(rounds):
        left = np.clip(x - slope, low, high) - x
        if np.abs(left).max() <= flat * max(1.0, abs(value)):
            return x, value, True, calls
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        d, kept = np.where(free, slope, 0.0), []
        for s, y in reversed(pairs):
            s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
            if s @ y > 1e-12 * (y @ y):
                a = s @ d / (s @ y)
                d = d - a * y
                kept.append((a, s, y))
        if kept:
            _, s, y = kept[0]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(slope).sum())
        for a, s, y in reversed(kept):
            d = d + (a - y @ d / (s @ y)) * s
        d = -np.where(free, d, 0.0)
        if d @ slope >= 0:
            d, pairs = np.where(free, -slope, 0.0) / max(1.0, np.abs(slope).sum()), []
        step, moved = 1.0, None
        while step > 1e-12:
            trial = np.clip(x + step * d, low, high)
            new, new_slope = f(trial)
            calls += 1
            if np.isfinite(new) and new <= value + 1e-4 * (slope @ (trial - x)):
                moved = trial
                break
            step /= 2 if step > 1e-3 else 10
        if moved is None:
            if not pairs:
                return x, value, bool(np.abs(left).max() <= 1e3 * flat * max(1.0, abs(value))), calls
            pairs = []  # curvature of another place: start again from the slope
            continue
        s, y = moved - x, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        still = still + 1 if value - new <= least * max(abs(value), 1e-300) else 0
        x, value, slope = moved, new, new_slope
        if still >= 3:
            return x, value, True, calls
    return x, value, False, calls


def bounded_scaling_fit(points: DataFrame, start: tuple[float, ...], low: tuple[float, ...], high: tuple[float, ...], delta: float = 1e-3, rounds: int = 200) -> tuple[tuple[float, ...], float, bool]:
    """(parameters, objective, settled) of the scaling law within bounds: every evaluation is one aggregate of loss and slopes.

    Parameters are measured by the curvature at the start, so that exponents and logarithms are of one size.
    """
    points = points.select("n", "d", "loss")

    def sums(p) -> tuple[float, np.ndarray, np.ndarray]:
        a, b, e, alpha, beta = (F.lit(float(x)) for x in p)
        t1, t2, t3 = F.exp(a - alpha * F.log("n")), F.exp(b - beta * F.log("d")), F.exp(e)
        s = t1 + t2 + t3
        j = [t1 / s, t2 / s, t3 / s, -t1 / s * F.log("n"), -t2 / s * F.log("d")]
        rows = points.select(scaling_residual(F.col("n"), F.col("d"), F.col("loss"), p).alias("r"), *[c.alias(f"j{k}") for k, c in enumerate(j)])
        size, push = F.abs("r"), F.greatest(F.least("r", F.lit(delta)), F.lit(-delta))
        cost = F.sum(F.when(size <= delta, 0.5 * F.col("r") * F.col("r")).otherwise(delta * (size - 0.5 * delta)))
        row = rows.agg(cost, *[F.sum(-push * F.col(f"j{k}")) for k in range(5)], *[F.sum(F.least(F.lit(1.0), delta / size) * F.col(f"j{k}") * F.col(f"j{k}")) for k in range(5)]).first()
        return row[0], np.array(row[1:6]), np.array(row[6:])

    size = 1 / np.sqrt(np.maximum(sums(start)[2], 1e-12))

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        cost, slope, _ = sums(x * size)
        return cost, slope * size

    x, cost, settled, _ = bounded_minimum(f, np.array(start) / size, np.array(low) / size, np.array(high) / size, rounds=rounds)
    return tuple(float(v) for v in x * size), float(cost), settled
