"""Interval union, complement, and free slots in business hours, per calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import same, with_range


def merged(busy: DataFrame, by: str = "cal") -> DataFrame:
    """(by, g, s, e): intervals (s, e) of each calendar merged where they overlap or touch, numbered by g from 1.

    Windows run within ranges of the starts, so that one busy calendar is many tasks; a range takes the latest end and the
    number of merged intervals of those before it.
    """
    # A struct is never null, and equal to one of the same null: plain joins and windows on it share their partitioning.
    rows = with_range(busy.select(F.struct(by).alias("__key"), "s", "e"), F.col("s").cast("double"))
    keys = ["__key", "__range"]
    ahead = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys).agg(F.max("e").alias("__end")).select(*keys, F.max("__end").over(ahead).alias("__open"))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    opened = F.greatest(F.col("__open"), F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flagged = rows.join(ends, keys).withColumn("__new", F.when(F.col("s") <= opened, 0).otherwise(1))
    pieces = flagged.withColumn("__own", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__own").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    offsets = pieces.groupBy(*keys).agg(F.max("__own").alias("__most")).select(*keys, F.coalesce(F.sum("__most").over(ahead), F.lit(0)).alias("__passed"))
    each = pieces.join(offsets, keys).withColumn("g", F.col("__own") + F.col("__passed"))
    return each.groupBy("__key", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(F.col("__key")[by].alias(by), "g", "s", "e")


def union(busy: DataFrame, by: str = "cal") -> DataFrame:
    """(by, s, e): intervals (s, e) of each calendar merged where they overlap or touch."""
    return merged(busy, by).drop("g")


def gaps(busy: DataFrame, calendars: DataFrame, start: str, end: str, by: str = "cal") -> DataFrame:
    """(by, s, e): what the intervals leave free of [start, end); all of it for a calendar without any."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    held = merged(busy, by).where((F.col("e") > lo) & (F.col("s") < hi))
    # Between the end of one and the start of the next, by number; where one of the two is missing, up to the edge.
    ends = held.select(F.col(by).alias("__by"), (F.col("g") + 1).alias("__g"), F.col("e").alias("a"))
    met = held.select(by, "g", F.col("s").alias("b")).join(ends, same([by, "g"], ["__by", "__g"]), "full")
    free = met.select(F.when(F.col("g").isNull(), F.col("__by")).otherwise(F.col(by)).alias(by), F.coalesce("a", lo).alias("s"), F.least("b", hi).alias("e"))
    known = held.select(F.col(by).alias("__by")).distinct()
    idle = calendars.select(by).distinct().join(known, same([by], ["__by"]), "left_anti").select(by, lo.alias("s"), hi.alias("e"))
    return free.unionByName(idle).where("s < e")


def free_slots(free: DataFrame, holidays: DataFrame, by: str = "cal", zone: str = "Asia/Tokyo", opens: str = "09:00", closes: str = "20:30", least_minutes: int = 30) -> DataFrame:
    """(by, day, label, slots): free time of weekdays within opening hours, in local time, listed by day in order of date."""
    local = free.select(by, F.from_utc_timestamp("s", zone).alias("s"), F.from_utc_timestamp("e", zone).alias("e"))
    days = local.select(by, "s", "e", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))).alias("day"))
    at = lambda clock: F.expr(f"day + interval {int(clock[:2])} hour + interval {int(clock[3:])} minute").cast("timestamp")
    cut = days.select(by, "day", F.greatest("s", at(opens)).alias("a"), F.least("e", at(closes)).alias("b")).where(F.weekday("day") < 5)
    cut = cut.join(holidays, "day", "left_anti").where(F.expr(f"b >= a + interval {least_minutes} minute"))
    text = F.concat(F.date_format("a", "HH:mm"), F.lit("–"), F.date_format("b", "HH:mm"))
    listed = cut.groupBy(by, "day").agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return listed.select(by, "day", F.date_format("day", "MM/dd (EEE)").alias("label"), F.array_join(F.transform("l", lambda x: x.t), ", ").alias("slots"))
