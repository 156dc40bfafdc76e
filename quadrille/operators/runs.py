"""Training-run tables: interpolation joins, filters, samples, budgets and objectives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import huber
from .lineage import cut
from .ordering import in_groups, with_key_range

#: Assumed throughput of a device over a 30-day month, and the cost of the largest run (fixed values).
FLOP_PER_MONTH = 430 * 10**12 * 3600 * 24 * 30
FLOP_PER_PARAM_TOKEN = FLOP_PER_MONTH * 2600 / (172e9 * 2e12)


def interpolate(queries: DataFrame, curve: DataFrame, by: list[str], ranges: int | None = None) -> DataFrame:
    """queries (by, x) with y of the piecewise-linear curve (by, x, y), constant beyond its ends.

    Of points of the curve that share x the largest y counts.  A query without any curve gets null.  Windows run within
    ranges of x that hold equally many rows, so that one long curve is many tasks, however its x are spread; what a range
    needs of those around it is a row for each.
    """
    known = curve.groupBy(*by, "x").agg(F.max("y").alias("y"))
    line = known.select(*by, "x", "y", F.lit(0).alias("q")).unionByName(queries.select(*by, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("q")))
    line = with_key_range(line, ["x"], ranges)
    line = line.withColumn("__p", F.when(F.col("q") == 0, F.struct("x", "y")))
    back = Window.partitionBy(*by, "__range").orderBy("x", "q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "__range").orderBy(F.desc("x"), "q").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("l", F.last("__p", ignorenulls=True).over(back)).withColumn("r", F.last("__p", ignorenulls=True).over(ahead))
    asked = line.where("q = 1")
    edges = line.groupBy(*by, "__range").agg(F.max("__p").alias("__hi"), F.min("__p").alias("__lo"))
    around = Window.partitionBy(*by).orderBy("__range")
    before = F.last("__hi", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__lo", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing))
    edges = cut(edges.select(*by, "__range", before.alias("__before"), after.alias("__after")))
    # null-safe, as keys may be null
    edges = edges.withColumnsRenamed({c: f"__e_{c}" for c in [*by, "__range"]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in [*by, "__range"]])
    asked = asked.join(edges, same).withColumn("l", F.coalesce("l", "__before")).withColumn("r", F.coalesce("r", "__after"))
    slope = (F.col("r.y") - F.col("l.y")) / F.nullif(F.col("r.x") - F.col("l.x"), F.lit(0))
    y = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull() | (F.col("l.x") == F.col("r.x")), F.col("l.y")).otherwise(F.col("l.y") + slope * (F.col("x") - F.col("l.x")))
    return asked.select(*by, "x", y.alias("y"))


def matching(runs: DataFrame, filters: list[dict]) -> DataFrame:
    """Runs that fit any of the filter documents; the conditions of a document all hold, an empty one fits all.

    tag: member of tags; before: created_at below; name: regular expression found anywhere in name.
    """
    def fits(f: dict) -> Column:
        c = F.lit(True)
        if "tag" in f:
            c = c & F.array_contains("tags", f["tag"])
        if "before" in f:
            c = c & (F.col("created_at") < F.lit(f["before"]).cast("timestamp"))
        if "name" in f:
            c = c & F.col("name").rlike(f["name"])
        return c

    return runs.where(reduce(lambda a, b: a | b, map(fits, filters), F.lit(False)))


def strided(history: DataFrame, by: str, step: str, samples: int) -> DataFrame:
    """At most about ``samples`` evenly spaced rows of each run; a long run is many tasks."""
    placed = in_groups(history, by, [step], "__r")
    return placed.where(F.expr(f"__r % cast(ceil(__n / {samples}D) as long) = 0")).select(*history.columns)


def indexed(history: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """(by, step, before, step of the value, idx): each row with its position in its run and the value before it."""
    placed = cut(in_groups(history.select(by, step, value), by, [step], "idx"))
    last = placed.select(F.col(by).alias("__by"), (F.col("idx") + 1).alias("__idx"), F.col(value).alias("before"))
    both = placed.join(last, F.col(by).eqNullSafe(F.col("__by")) & (F.col("idx") == F.col("__idx")), "left")
    return both.select(by, step, "before", (F.col(value) - F.col("before")).alias("step"), "idx")


def iso_budget(budgets: DataFrame, sizes: DataFrame, a: float, b: float, e: float, alpha: float, beta: float) -> DataFrame:
    """Tokens (billions) and expected loss of each model size (params, billions) at each budget (gpu_months)."""
    grid = budgets.crossJoin(sizes)  # two short lists of parameters
    tokens = F.col("gpu_months") * F.lit(float(FLOP_PER_MONTH)) / F.lit(FLOP_PER_PARAM_TOKEN) / F.col("params") / F.lit(1e18)
    grid = grid.withColumn("tokens", tokens)
    loss = F.lit(e) + F.lit(a) / F.pow(F.col("params") * F.lit(1e9), F.lit(alpha)) + F.lit(b) / F.pow(F.col("tokens") * F.lit(1e9), F.lit(beta))
    return grid.withColumn("loss", loss).withColumn("label", token_label(F.col("tokens")))


def token_label(tokens: Column) -> Column:
    """Billions of tokens in short: Q for 1e15, T for 1e12, B."""
    whole = lambda by, unit: F.concat(F.floor(tokens / by).cast("string"), F.lit(unit))
    tenth = lambda by, unit: F.format_string(f"%.1f{unit}", tokens / by)
    return F.when(tokens > 2e6, whole(1e6, "Q")).when(tokens > 1e6, tenth(1e6, "Q")).when(tokens > 2e3, whole(1e3, "T")).when(tokens > 1e3, tenth(1e3, "T")).otherwise(whole(1.0, "B"))


def scaling_residual(n: Column, d: Column, loss: Column, p: tuple[float, ...]) -> Column:
    """log loss less its log-sum-exp prediction by parameters (a, b, e, alpha, beta)."""
    a, b, e, alpha, beta = (F.lit(float(x)) for x in p)
    return F.log(loss) - F.log(F.exp(a - alpha * F.log(n)) + F.exp(b - beta * F.log(d)) + F.exp(e))


def scaling_objective(points: DataFrame, p: tuple[float, ...], delta: float = 1e-3) -> DataFrame:
    """One row: sum of Huber residuals of (n, d, loss)."""
    return points.agg(F.sum(huber(scaling_residual(F.col("n"), F.col("d"), F.col("loss"), p), delta)).alias("objective"))


def scale(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / (high - low)


def unscale(value: Column, low: Column, high: Column) -> Column:
    return value * (high - low) + low


def in_range(value: Column, low: float, high: float) -> Column:
    """Open at both ends."""
    return (value > low) & (value < high)


def tokens(steps: Column, batch: Column, length: Column) -> Column:
    return steps * batch * length


def months(params: Column, tokens_: Column) -> Column:
    """Device months of training params on tokens."""
    return F.lit(FLOP_PER_PARAM_TOKEN) * params * tokens_ / F.lit(float(FLOP_PER_MONTH))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table; raises if a key of rows isn't there, instead of losing rows."""
    lost = rows.join(table, key, "left_anti").select(key).first()
    if lost:
        raise KeyError(lost[0])
    return rows.join(table, key)


def group_fetch(rows: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """The rows of one group, in order; raises if there is none."""
    own = rows.where(F.col(key) == F.lit(value))
    if own.isEmpty():
        raise KeyError(value)
    return own.orderBy(*order)


def mean_curve(fitted: DataFrame, grid: DataFrame) -> DataFrame:
    """(x, y): the mean over tasks (x0, k, low, high) of the fitted sigmoid, in each task's own units, at each x of grid."""
    blocks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = fitted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = grid.withColumn("__block", F.pmod(F.xxhash64("x"), F.lit(blocks))).join(every, "__block")
    y = unscale(1 / (1 + F.exp(-F.col("k") * (F.col("x0") - F.col("x")))), F.col("low"), F.col("high"))
    return pairs.groupBy("x").agg(F.avg(y).alias("y"))
