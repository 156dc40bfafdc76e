"""Ranks, prefix sums, runs and balanced splits that hold no ordered whole in one task."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut as cut_lineage

#: Sampled keys for each range; quantiles that split the values around a position, their accuracy, and values that are few.
OVERSAMPLE, SLICES, ACCURACY, FEW = 64, 256, 4096, 4096


def search(count: int, passed) -> Column:
    """How many of ``count`` sorted bounds lie before a row, by a binary search: passed(k) tells whether bound k does."""
    steps = [1 << k for k in reversed(range(count.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= count) & passed(at + step - 1), at + step).otherwise(at))


def with_range(df: DataFrame, rough: Column, buckets: int | None = None) -> DataFrame:
    """df with ``__range``: equal parts of the rows by approximate quantiles of rough; equal values share one, nulls are -1."""
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = df.withColumn("__rough", rough)
    bounds = sorted(set(led.approxQuantile("__rough", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    at = search(len(bounds), lambda k: F.get(F.lit(bounds), k) < F.col("__rough"))
    return led.withColumn("__range", F.when(F.col("__rough").isNull(), -1).otherwise(at)).drop("__rough")


def same(left: list[str], right: list[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of other, which has a row for each value of the keys, nulls too."""
    own = [f"__{k}_" for k in keys]
    return df.join(other.withColumnsRenamed(dict(zip(keys, own, strict=True))), same(keys, own)).drop(*own)


def with_key_range(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """df with ``__range``: about equal parts of the rows in the order of all keys together, of any types that have an order.

    Bounds are keys of a sample, OVERSAMPLE for each range.  Where one key as a whole fills ranges by itself, its rows are
    dealt to them at random (in what is written down first).  Nulls come first.
    """
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = OVERSAMPLE * buckets / max(df.count(), 1)

    def bounds(rows: DataFrame, by: list[str]) -> list:
        drawn = rows.select(*[F.col(f"`{k}`") for k in by])
        drawn = drawn.sample(share, 17) if share < 1 else drawn
        each = drawn.repartition(1).sortWithinPartitions(*[F.col(f"`{k}`") for k in by]).collect()  # some OVERSAMPLE * buckets keys
        return [each[len(each) * k // buckets] for k in range(1, buckets) if len(each) * k // buckets]

    at = bounds(df, keys)
    if len({tuple(b) for b in at}) < len(at) - 1 and share < 1:
        df, keys = cut_lineage(df.withColumn("__deal", F.rand(23))), [*keys, "__deal"]
        at = bounds(df, keys)
    types = [df.schema[k].dataType for k in keys]
    told = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types, strict=True))]) for b in at])
    own = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    return df.withColumn("__range", search(len(at), lambda k: F.get(told, k) < own)).drop("__deal")


def ranked(df: DataFrame, lead: Column, ties: list[str], to: str = "pos", buckets: int | None = None, by: str | None = None) -> DataFrame:
    """df with ``to``: its 0-based position by (lead, ties); with ``by``, a column, by (by, lead, ties).

    Rows are dealt to ranges of the whole key (any bounds give the same positions), numbered within their range, and moved up
    by the rows of the ranges below.  So neither a frequent lead nor a frequent key fills one task.  Nulls come first.
    """
    keys = [*([by] if by else []), "__lead", *ties]
    led = with_key_range(df.withColumn("__lead", lead), keys, buckets)
    sizes = led.groupBy("__range").count().orderBy("__range").collect()  # a row for each range
    before = [0, *accumulate(r["count"] for r in sizes)]
    starts = df.sparkSession.createDataFrame([(r["__range"], n) for r, n in zip(sizes, before, strict=False)], "__range int, __start long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    at = led.withColumn("__within", within).join(F.broadcast(starts), "__range")  # a row for each range
    return at.select(*df.columns, (F.col("__within") + F.col("__start")).cast("long").alias(to))


def in_groups(df: DataFrame, by: str, order: list[str], to: str = "pos") -> DataFrame:
    """df with ``to``, its 0-based position in its group by order, and ``__n``, the rows of the group.  A large group is many tasks."""
    placed = cut_lineage(ranked(df, F.col(order[0]), order[1:], "__at", by=by))
    groups = placed.groupBy(by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    return beside(placed, groups, [by]).withColumn(to, F.col("__at") - F.col("__first")).drop("__at", "__first")


def bucket_offsets(df: DataFrame, key: str, group: int = 4096) -> DataFrame:
    """(key, n, offset): histogram of an integer key and its exclusive prefix sum, in two levels."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("__g", (F.col(key) - F.pmod(F.col(key), F.lit(group))).cast("long"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("__g").agg(F.sum("n").alias("__sum"))
    groups = groups.select("__g", F.coalesce(F.sum("__sum").over(before().orderBy("__g")), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum("n").over(before("__g").orderBy(key)), F.lit(0))
    return counts.withColumn("__own", own).join(groups, "__g").select(key, "n", (F.col("__own") + F.col("__base")).alias("offset"))


def median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, pos, median): of each of a few groups the value at position n div 2 in its order, nulls first.

    Nothing is sorted: each pass takes two quantiles around the position as bounds, and counts what lies below and between
    them, until few values are between, or only one.
    """
    rows = df.select(F.col(by).alias("__by"), F.col(value).alias("__v"))
    state = rows.groupBy("__by").agg(F.count("*").alias("n"), F.count("__v").alias("known"))
    state = state.select("__by", F.expr("n div 2").alias("pos"), F.expr("n div 2 - (n - known)").alias("at"), F.col("known").alias("held"), F.lit(0.0).alias("width"))
    kind = rows.schema["__v"].dataType
    state = cut_lineage(state.withColumn("lo", F.lit(None).cast(kind)).withColumn("hi", F.lit(None).cast(kind)).withColumn("done", F.col("at") < 0))

    def between(live: DataFrame) -> DataFrame:
        told = live.select("__by", "lo", "hi", "at", "held", "width")
        inside = (F.col("lo").isNull() | (F.col("__v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") < F.col("hi")))
        return beside(rows.where("__v is not null"), F.broadcast(told), ["__by"]).where(inside)  # a few groups

    while True:
        live = state.where(f"not done and held > {FEW}")
        if live.isEmpty():
            break
        share = F.col("at") / F.col("held")
        # bounds by quantiles of the values between the last ones; wider if the position was missed
        near = between(live).groupBy("__by").agg(F.percentile_approx("__v", [k / SLICES for k in range(SLICES + 1)], ACCURACY).alias("q"))
        slot = F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int")
        near = beside(live, near, ["__by"])
        low, high = F.greatest(slot - F.col("width").cast("int"), F.lit(0)), F.least(slot + 1 + F.col("width").cast("int"), F.lit(SLICES))
        tried = near.select("__by", "pos", "at", "held", "width", "lo", "hi", F.get("q", low).alias("new_lo"), F.get("q", high).alias("new_hi"))
        counted = beside(between(live), F.broadcast(tried.select("__by", "new_lo", "new_hi")), ["__by"]).groupBy("__by")
        v, lo, hi = F.col("__v"), F.col("new_lo"), F.col("new_hi")
        sizes = {"below": v < lo, "on_lo": v == lo, "between": (v > lo) & (v < hi), "on_hi": (v == hi) & (hi > lo)}
        counted = cut_lineage(counted.agg(*[F.count_if(c).alias(n) for n, c in sizes.items()]))
        both = beside(tried, counted, ["__by"]).withColumn("up", F.col("at") - F.col("below"))
        hit = F.expr("up >= 0 and up < on_lo + between + on_hi")
        found = F.when(hit & F.expr("up < on_lo"), F.col("new_lo")).when(hit & F.expr("up >= on_lo + between"), F.col("new_hi"))
        both = both.withColumn("found", found).withColumn("hit", hit)
        moved = both.select(  # a value that is met ends the search; else bounds are left out, so that every pass has fewer values
            "__by", "pos", F.expr("if(found is not null, 0, if(hit, up - on_lo, at))").alias("at"), F.expr("if(hit, between, held)").alias("held"), F.expr("if(hit, 0D, 2 * width + 1)").alias("width"),
            F.expr("coalesce(found, if(hit, new_lo, lo))").alias("lo"), F.expr("if(hit, new_hi, hi)").alias("hi"), F.expr("found is not null").alias("done"),
        )
        state = cut_lineage(state.where(f"done or held <= {FEW}").unionByName(moved))
    few = between(state.where("not done")).groupBy("__by").agg(F.array_sort(F.collect_list("__v")).alias("few"))  # FEW at most
    found = F.when(F.col("at") < 0, F.lit(None)).when(F.col("done"), F.col("lo")).otherwise(F.get("few", F.col("at").cast("int")))
    told = state.select("__by", "pos", "at", "done", "lo").withColumnRenamed("__by", "__k").join(few, F.col("__k").eqNullSafe(F.col("__by")), "left")
    return told.select(F.col("__k").alias(by), "pos", found.cast(kind).alias("median"))


def runs(df: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """(by, run, key, n, first): runs of an equal key in the order of each partition.

    Windows run within ranges of the order (a number or a time), so that one long partition is many tasks; a range takes the
    last key and the number of runs of those before it.  Null is a partition of its own.
    """
    rows = with_range(df.select(F.struct(by).alias("__key"), order, key), F.col(order).cast("double"))
    keys = ["__key", "__range"]
    ahead = Window.partitionBy("__key").orderBy("__range")
    last = rows.groupBy(*keys).agg(F.max_by(key, order).alias("__last")).select(*keys, F.lag("__last").over(ahead).alias("__before"))
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(key).over(w))
    flagged = rows.join(last, keys).withColumn("__new", F.coalesce((F.col(key) != before).cast("int"), F.lit(0)))
    numbered = flagged.withColumn("__own", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*keys, "__own", key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    passed = F.coalesce(F.sum("__most").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.groupBy(*keys).agg(F.max("__own").alias("__most")).select(*keys, passed.alias("__passed"))
    each = pieces.join(offsets, keys).withColumn("run", F.col("__own") + F.col("__passed"))
    return each.groupBy("__key", "run", key).agg(F.sum("n").alias("n"), F.min("first").alias("first")).select(F.col("__key")[by].alias(by), "run", key, "n", "first")


def bisect(df: DataFrame, axes: list[str], levels: int, ident: str = "id") -> DataFrame:
    """df with ``part``: halved at the median of the axis level mod dimensions, ``levels`` times; any coordinates."""
    parts = df.withColumn("part", F.lit(0).cast("long"))
    for level in range(levels):
        sizes = parts.groupBy("part").agg(F.count("*").alias("__n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # 2^level rows
        placed = ranked(parts, F.col(axes[level % len(axes)]), [ident], "__pos", by="part").join(offsets, "part")
        upper = (F.col("__pos") - F.col("__base") >= F.expr("__n div 2")).cast("long")
        parts = cut_lineage(placed.withColumn("part", 2 * F.col("part") + upper).select(*parts.columns))
    return parts


def rank_halving(spark, ranks: int) -> DataFrame:
    """(level, rank, disp, cnt, other, color, key): ranges of ranks halved until each holds one."""
    depth = max(0, (ranks - 1).bit_length())
    df = spark.range(ranks).select(F.col("id").cast("int").alias("rank"), F.lit(0).alias("disp"), F.lit(ranks).alias("cnt"), F.lit(ranks).alias("other"), F.lit(0).alias("color"))
    out = None
    for level in range(depth):
        split = F.floor(F.col("cnt") / 2).cast("int")
        low = F.col("rank") - F.col("disp") < split
        df = df.select(
            "rank", F.when(low, F.col("disp")).otherwise(F.col("disp") + split).alias("disp"), F.when(low, split).otherwise(F.col("cnt") - split).alias("cnt"),
            F.when(low, F.col("cnt") - split).otherwise(split).alias("other"), (2 * F.col("color") + F.when(low, 0).otherwise(1)).alias("color"),
        )
        if level == depth - 1:
            df = df.withColumn("color", F.col("disp"))
        row = df.select(F.lit(level).alias("level"), "rank", "disp", "cnt", "other", "color", (F.col("rank") - F.col("disp")).alias("key"))
        out = row if out is None else out.unionByName(row)
    return out


def weighted_bisect(df: DataFrame, axes: list[str], ranks: int, ident: str = "id") -> DataFrame:
    """df with ``part`` (first rank of its range): halved along the longest axis in proportion to the ranks.

    Each range of ranks [a, b) holding n rows gives its first n * floor(r/2) / r rows to the lower half of its r ranks.
    """
    parts, live = df.withColumn("part", F.lit(0)), {0: ranks}
    while any(r > 1 for r in live.values()):
        box = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
        rows = sorted(box.collect(), key=lambda r: r.part)  # a row for each part: the number of ranks at most
        axis, cut, base, up, split = {}, {}, {}, 0, {}
        for r in rows:
            lengths = [r[f"hi_{a}"] - r[f"lo_{a}"] for a in axes]
            axis[r.part] = lengths.index(max(lengths))
            split[r.part] = live[r.part] // 2
            cut[r.part] = r.n * split[r.part] // live[r.part]
            base[r.part] = up
            up += r.n
        def of(table):
            return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), F.col("part"))

        value = F.coalesce(*[F.when(of(axis) == k, F.col(a)) for k, a in enumerate(axes)])
        placed = ranked(parts, value, [ident], "__pos", by="part")
        upper = F.col("__pos") - of(base) >= of(cut)
        parts = cut_lineage(placed.withColumn("part", F.when(upper & (of(split) > 0), F.col("part") + of(split)).otherwise(F.col("part"))).drop("__pos"))
        live = {p: n for q, r in live.items() for p, n in (((q, r // 2), (q + r // 2, r - r // 2)) if r > 1 else ((q, r),))}
    return parts


def refined_bisect(df: DataFrame, axes: list[str], ranks: int, weight: str | None = None, bins: int = 16, refinements: int = 3) -> tuple[DataFrame, list[dict]]:
    """(df with ``part``, planes): halved along the longest axis in proportion to the ranks, by weight; no row is ranked.

    The plane of a part is narrowed by ``refinements`` histograms of ``bins`` bins, one aggregation each for all parts of a
    level; what the last bin holds is what a part can be off.  Rows move by comparing with a plane, without a shuffle.  Rows
    with a null or odd coordinate stay below.  The driver holds ranks times bins numbers.
    """
    parts, planes, live = df.withColumn("part", F.lit(0)), [], {0: ranks}
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)

    def of(table: dict[int, object], none) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), F.col("part")), F.lit(none)) if table else F.lit(none)

    while any(r > 1 for r in live.values()):
        boxes = parts.groupBy("part").agg(F.sum(w).alias("w"), *[f(a).cast("double").alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()  # a row for each part
        axis, low, high, goal, last = {}, {}, {}, {}, {}
        for r in boxes:
            if live[r.part] > 1 and all(r[f"{n}_{a}"] is not None for n in ("lo", "hi") for a in axes):
                lengths = [r[f"hi_{a}"] - r[f"lo_{a}"] for a in axes]
                k = lengths.index(max(lengths))
                axis[r.part], low[r.part], high[r.part] = k, r[f"lo_{axes[k]}"], r[f"hi_{axes[k]}"]
                goal[r.part] = r.w * (live[r.part] // 2) / live[r.part]
        value = F.coalesce(*[F.when(of(axis, -1) == k, F.col(a).cast("double")) for k, a in enumerate(axes)])
        for _ in range(refinements):
            here = parts.withColumn("__v", value).where("__v is not null").where((F.col("__v") >= of(low, 0.0)) & (F.col("__v") <= of(high, 0.0)))
            width = F.nullif(of(high, 0.0) - of(low, 0.0), F.lit(0.0))
            at = F.least(F.coalesce(F.floor((F.col("__v") - of(low, 0.0)) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
            held: dict[int, list[float]] = {p: [0.0] * bins for p in axis}
            for r in here.groupBy("part", at.alias("bin")).agg(F.sum(w).alias("w")).collect():  # bins for each part
                held[r.part][r.bin] = r.w
            for p, weights in held.items():
                wide, up = (high[p] - low[p]) / bins, 0
                while up < bins - 1 and weights[up] <= goal[p]:
                    goal[p] -= weights[up]
                    up += 1
                low[p], high[p], last[p] = low[p] + up * wide, low[p] + (up + 1) * wide, weights[up]
        split = {p: live[p] // 2 for p in axis}
        plane = {p: low[p] if goal[p] * 2 < last[p] or not goal[p] else high[p] for p in axis}  # the nearer edge
        planes += [{"part": p, "axis": axes[axis[p]], "plane": plane[p], "ranks": live[p]} for p in axis]
        upper = F.coalesce(value >= of(plane, 0.0), F.lit(False))
        parts = parts.withColumn("part", F.when(upper, F.col("part") + of(split, 0)).otherwise(F.col("part")))
        live = {p: n for q, r in live.items() for p, n in (((q, r // 2), (q + r // 2, r - r // 2)) if r > 1 else ((q, r),))}
    return parts, planes


def dense_keys(df: DataFrame, key: str, group: int = 4096) -> DataFrame:
    """(key, index): the distinct integer keys numbered from 0 in order, in two levels."""
    distinct = df.select(key).distinct()
    numbered = bucket_offsets(distinct, key, group)
    return numbered.select(key, F.col("offset").cast("long").alias("index"))
