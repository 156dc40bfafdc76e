"""Fields and forces of radial kernels on an adaptive tree, for points anywhere, in one to three dimensions.

A cell is split while it holds ``ncrit`` places or more, so leaves are small wherever points crowd.  Moments are gathered
from the leaves to all ancestors in one aggregation.  Pairs of cells are walked from the root down, all pairs of a depth
as one join: a pair whose radii are small beside its distance meets by expansions, two leaves meet point by point, and any
other pair is replaced by those of its children.  Local expansions go down to the leaves in one join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import points as P
from ..functions.taylor import Coulomb, Expansion, direct
from .lineage import cut

#: Bits of a place along an axis, and so the deepest level; levels looked at together; pairs of cells expanded together.
DEPTH, STEP, PAIRS = 50, 3, 2048


def finite(axes: list[str]):
    return reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) for a in axes])


def placed(points: DataFrame, axes: list[str]) -> tuple[DataFrame, list[float], float]:
    """((axes.., q, k<axis>..), low corner, width): one row for each place of the points' box, charges summed up."""
    at = points.where(finite(axes)).groupBy(*axes).agg(F.sum("q").alias("q"))
    at = cut(at.select(*[F.col(a).cast("double").alias(a) for a in axes], F.col("q").cast("double").alias("q")))
    box = at.agg(*[f(a).alias(f"{n}{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    low = [box[f"lo{a}"] or 0.0 for a in axes]
    width = max([(box[f"hi{a}"] or 0.0) - lo for a, lo in zip(axes, low, strict=True)]) or 1.0
    bits = {f"k{a}": F.least(F.floor((F.col(a) - F.lit(lo)) / F.lit(width) * F.lit(2.0**DEPTH)).cast("long"), F.lit(2**DEPTH - 1)) for a, lo in zip(axes, low, strict=True)}
    return at.withColumns(bits), low, width


def with_leaves(at: DataFrame, axes: list[str], ncrit: int) -> DataFrame:
    """at with ``level``: that of the shallowest cell around the place with fewer than ncrit places (DEPTH if there is none).

    Cells are counted some levels at a time; only places in cells that are still too full are looked at again.
    """
    keys, done, above = [f"k{a}" for a in axes], None, -1
    level = min(DEPTH, P.adaptive_level(at.count(), ncrit, len(axes)) + 1)
    while True:
        own = [F.shiftright(k, DEPTH - level).alias(f"c{k}") for k in keys]
        live = at.select("*", *own)
        cells = cut(live.groupBy(*[f"c{k}" for k in keys]).agg(F.count("*").alias("n")))
        up = cells.withColumn("level", F.explode(F.sequence(F.lit(above + 1), F.lit(level))))
        up = up.withColumns({f"p{k}": F.expr(f"shiftright(c{k}, {level} - level)") for k in keys})
        whole = up.groupBy("level", *[f"p{k}" for k in keys]).agg(F.sum("n").alias("whole"))
        told = up.join(whole, ["level", *[f"p{k}" for k in keys]]).groupBy(*[f"c{k}" for k in keys])
        told = cut(told.agg(F.min(F.when(F.col("whole") < ncrit, F.col("level"))).alias("level")))
        found = live.join(told, [f"c{k}" for k in keys]).select(*at.columns, "level")
        if level == DEPTH:
            found = found.withColumn("level", F.coalesce("level", F.lit(DEPTH)))
        ready = found.where("level is not null")
        done = ready if done is None else done.unionByName(ready)
        if level == DEPTH or not told.where("level is null").limit(1).count():
            return done
        at, above, level = cut(found.where("level is null").drop("level")), level, min(DEPTH, level + STEP)


class Box:
    """Where the cells of each level lie."""

    def __init__(self, axes: list[str], low: list[float], width: float):
        self.axes, self.low, self.width = axes, low, width

    def centres(self, frame: pd.DataFrame, level: str = "level", prefix: str = "i") -> np.ndarray:
        size = self.width / 2.0 ** frame[level].to_numpy(float)
        return np.stack([lo + (frame[f"{prefix}{a}"].to_numpy(float) + 0.5) * size for a, lo in zip(self.axes, self.low, strict=True)], 1)


class Tree:
    """Cells (cell, level, i<axis>.., n, m, radius, leaf), and blocks (cell, points): the places and charges of each leaf."""

    def __init__(self, points: DataFrame, axes: list[str], ncrit: int, order: int):
        self.axes, self.ncrit, self.taylor = axes, ncrit, Expansion(len(axes), order)
        at, low, width = placed(points, axes)
        self.box = Box(axes, low, width)
        keys = self.keys = [f"i{a}" for a in axes]
        at = with_leaves(at, axes, ncrit).withColumns({i: F.expr(f"shiftright(k{a}, {DEPTH} - level)") for i, a in zip(keys, axes, strict=True)})
        blocks = cut(at.groupBy("level", *keys).agg(F.collect_list(F.array(*axes, "q")).alias("points")))  # under ncrit places each
        up = self.gathered(blocks)
        sums = [F.sum(F.get("m", F.lit(k))) for k in range(self.taylor.size)]
        cells = up.groupBy("level", *keys).agg(F.sum("n").alias("n"), F.array(*sums).alias("m"), F.max("radius").alias("radius"), F.max("leaf").alias("leaf"))
        self.cells = cut(cells.withColumn("cell", F.monotonically_increasing_id()))
        self.blocks = cut(blocks.join(self.cells.select("cell", "level", *keys), ["level", *keys]))

    def ancestors(self, leaves: DataFrame) -> DataFrame:
        each = leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
        return each.withColumns({f"u{a}": F.expr(f"shiftright(i{a}, level - up)") for a in self.axes})

    def gathered(self, blocks: DataFrame) -> DataFrame:
        """Moments of each leaf about the centres of all its ancestors, itself included."""
        taylor, dims, axes, box = self.taylor, len(self.axes), self.axes, self.box

        def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                m, r, n = np.zeros((len(x), taylor.size)), np.zeros(len(x)), np.zeros(len(x), int)
                for row, (points, centre) in enumerate(zip(x.points, box.centres(x), strict=True)):
                    p = np.stack(points)
                    d = p[:, :dims] - centre
                    m[row], r[row], n[row] = p[:, dims] @ taylor.powers(d), math.sqrt((d * d).sum(1).max()), len(p)
                yield x.drop(columns="points").assign(m=list(m), radius=r, n=n)

        def raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    d = box.centres(x) - box.centres(x, "up", "u")
                    moved = taylor.raised(np.stack(x.m), d)
                    radius = x.radius + np.sqrt((d * d).sum(1))
                    yield pd.DataFrame({"level": x.up, **{f"i{a}": x[f"u{a}"] for a in axes}, "n": x.n, "m": list(moved), "radius": radius, "leaf": x.up == x.level})

        place = "level int, " + ", ".join(f"{i} long" for i in self.keys)
        own = cut(blocks.mapInPandas(leaf, f"{place}, m array<double>, radius double, n long"))
        return self.ancestors(own).mapInPandas(raised, f"{place}, n long, m array<double>, radius double, leaf boolean")

    def walk(self, theta: float) -> tuple[DataFrame, DataFrame]:
        """(far, near): pairs (t, s) of cells whose radii are at most theta times their distance, and of leaves that aren't."""
        size = F.lit(self.box.width) / F.pow(F.lit(2.0), F.col("level"))
        middle = {f"x{a}": F.lit(lo) + (F.col(f"i{a}") + 0.5) * size for a, lo in zip(self.axes, self.box.low, strict=True)}
        cells = cut(self.cells.withColumns(middle).select("cell", "level", *self.keys, *middle, "radius", "leaf"))
        up = cells.where("not leaf").select(F.col("cell").alias("from"), (F.col("level") + 1).alias("level"), *[F.col(i).alias(f"p{i}") for i in self.keys])
        kids = cells.withColumns({f"p{i}": F.shiftright(i, 1) for i in self.keys}).join(up, ["level", *[f"p{i}" for i in self.keys]])
        stay = cells.where("leaf").withColumn("from", F.col("cell"))
        names = ["cell", *middle, "radius", "leaf"]
        step = cut(kids.select("from", *names).unionByName(stay.select("from", *names)))
        side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
        root = cells.where("level = 0").select(*names)
        front = side(root, "t").join(side(root, "s"))  # one row
        far, near = [], []
        while True:
            gaps = [F.col(f"t_{c}") - F.col(f"s_{c}") for c in middle]
            distance = F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))
            front = cut(front.withColumn("far", (F.col("t_radius") + F.col("s_radius") <= F.lit(theta) * distance) & (distance > 0)))
            far.append(front.where("far").select(F.col("t_cell").alias("t"), F.col("s_cell").alias("s"), *[g.alias(f"d{a}") for g, a in zip(gaps, self.axes, strict=True)]))
            near.append(front.where("not far and t_leaf and s_leaf").select(F.col("t_cell").alias("t"), F.col("s_cell").alias("s")))
            rest = front.where("not far and not (t_leaf and s_leaf)").select(F.col("t_cell").alias("t_from"), F.col("s_cell").alias("s_from"))
            if not rest.limit(1).count():
                break
            front = rest.join(side(step, "t"), "t_from").join(side(step, "s"), "s_from").drop("t_from", "s_from")
        return reduce(DataFrame.unionByName, far), reduce(DataFrame.unionByName, near)


def fields(points: DataFrame, axes: list[str], kernel=None, order: int = 6, theta: float = 0.6, ncrit: int = 64) -> DataFrame:
    """(id, u, g<axis>..): the sum over all points of q times the kernel, and its gradient, at each point (id, axes.., q).

    Points may lie anywhere: cells are those of their box.  Repeated places are one place with the sum of their charges, and
    have the same field; a leaf holds fewer than ncrit places, unless more lie within 2^-50 of the box.  Points with a null,
    NaN or infinite coordinate neither act nor have a field (null); a null charge is none.  Singular kernels leave out the
    point itself.  An empty table gives no rows.  The error falls as theta to the order.
    """
    kernel, dims = kernel or Coulomb(), len(axes)
    own = points.select("id", *[F.col(a).cast("double").alias(a) for a in axes], F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("q"))
    tree = Tree(own, axes, ncrit, order)
    taylor, box = tree.taylor, tree.box
    far, near = tree.walk(theta)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for k in range(0, len(x), PAIRS):
                part = x.iloc[k : k + PAIRS]
                t, row = np.unique(part.t.to_numpy(), return_inverse=True)
                sums = np.zeros((len(t), taylor.size))
                np.add.at(sums, row, taylor.met(np.stack(part.m), kernel, part[[f"d{a}" for a in axes]].to_numpy(float)))
                yield pd.DataFrame({"t": t, "l": list(sums)})

    total = lambda name: F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(taylor.size)]).alias(name)
    moments = tree.cells.select(F.col("cell").alias("s"), "m")
    local = cut(far.join(moments, "s").mapInPandas(met, "t long, l array<double>").groupBy("t").agg(total("l")))

    def lowered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield pd.DataFrame({"cell": x.cell, "l": list(taylor.lowered(np.stack(x.l), box.centres(x) - box.centres(x, "up", "u")))})

    place = ["level", *tree.keys]
    named = local.join(tree.cells.select(F.col("cell").alias("t"), *place), "t").select("l", F.col("level").alias("up"), *[F.col(f"i{a}").alias(f"u{a}") for a in axes])
    down = tree.ancestors(tree.blocks.select("cell", *place)).join(named, ["up", *[f"u{a}" for a in axes]])
    at_leaf = down.mapInPandas(lowered, "cell long, l array<double>").groupBy("cell").agg(total("l"))
    gradient = [f"g{a}" for a in axes]
    schema = f"cell long, place int, {', '.join(f'{a} double' for a in axes)}, u double, {', '.join(f'{g} double' for g in gradient)}"

    def evaluated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for cell, points, l, centre in zip(x.cell, x.points, x.l, box.centres(x), strict=True):
                p = np.stack(points)[:, :dims]
                found = np.zeros((len(p), 1 + dims)) if l is None else taylor.value(np.asarray(l), p - centre)
                yield pd.DataFrame({"cell": cell, "place": range(len(p)), **dict(zip(axes, p.T, strict=True)), "u": found[:, 0], **{g: found[:, 1 + k] for k, g in enumerate(gradient)}})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sums: dict[int, np.ndarray] = {}
            for t, a, b in zip(x.t, x.points, x.others, strict=True):
                mine, theirs = np.stack(a), np.stack(b)
                found = direct(kernel, mine[:, :dims], theirs[:, :dims], theirs[:, dims])
                sums[t] = sums[t] + found if t in sums else found
            for t, found in sums.items():
                yield pd.DataFrame({"cell": t, "place": range(len(found)), **dict.fromkeys(axes, math.nan), "u": found[:, 0], **{g: found[:, 1 + k] for k, g in enumerate(gradient)}})

    blocks = tree.blocks.select("cell", "points")
    from_far = tree.blocks.join(at_leaf, "cell", "left").mapInPandas(evaluated, schema)
    both = near.join(blocks.withColumnRenamed("cell", "t"), "t").join(blocks.select(F.col("cell").alias("s"), F.col("points").alias("others")), "s")
    from_near = both.select("t", "points", "others").mapInPandas(summed, schema)
    each = from_far.unionByName(from_near).groupBy("cell", "place").agg(*[F.min(a).alias(a) for a in axes], *[F.sum(c).alias(c) for c in ("u", *gradient)])  # NaN is the largest
    found = cut(each.drop("cell", "place"))
    return own.drop("q").join(found, axes, "left").select("id", "u", *gradient)
