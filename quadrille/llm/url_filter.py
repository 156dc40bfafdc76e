"""URL filters as a sort-merge range join, with DataFrame operations only.

A host is canonicalised to its reversed labels, each ended by a dot (``www.example.com`` -> ``com.example.www.``), so
that "this host and its subdomains" is the interval of strings that start with the key; a path rule is the interval of
paths that start with it.  Such intervals nest or are apart, so those that are open at a URL are on the stack of the
latest rule before it.  Rules are rows of a table; each holds its stack as the lengths of its own prefixes that are rules.

Two sorted sweeps over the different URLs: the first finds the hosts with rules that are open at a URL, the second, for
each of them, the longest open path.  A sweep runs in ranges of keys; a range gets the rules that lie in it, and one row for
the latest rule before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_key_range
from .common import LOWER, UPPER, shuffle_partitions, stored, without

OUTPUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lowered; path: then up to ``? #``. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """The labels of a host in reverse, each ended by a dot; the same way back from a key without its last dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def host_of(key: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.left(key, F.char_length(key) - 1), "[.]")), ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """(hk, rp, verdict) of rules (verdict, host, path), once each: block wins over allow.  Null host or path is empty."""
    known = [F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")]
    rows = rules.select(reversed_key(F.translate(known[0], UPPER, LOWER)).alias("hk"), known[1].alias("rp"), "verdict")
    return rows.groupBy("hk", "rp").agg(F.max("verdict").alias("verdict"))


def host_stacks(rules: DataFrame) -> DataFrame:
    """(hk, open): the lengths of the prefixes of each rule's host, itself included, that are hosts of rules too."""
    hosts = rules.select("hk").distinct()
    labels = hosts.withColumn("labels", F.split(F.expr("left(hk, char_length(hk) - 1)"), "[.]"))
    prefixes = labels.select("hk", F.explode(F.expr("transform(sequence(1, size(labels)), k -> concat(array_join(slice(labels, 1, k), '.'), '.'))")).alias("prefix"))
    return prefixes.join(hosts.withColumnRenamed("hk", "prefix"), "prefix").groupBy("hk").agg(F.collect_list(F.char_length("prefix")).alias("open"))


def path_stacks(rules: DataFrame) -> DataFrame:
    """(hk, rp, open): length and verdict of the prefixes of each rule's path, itself included, that are rules of its host."""
    prefixes = rules.select("hk", "rp", F.explode(F.expr("transform(sequence(0, char_length(rp)), k -> left(rp, k))")).alias("prefix"))
    found = prefixes.join(rules.select("hk", F.col("rp").alias("prefix"), "verdict"), ["hk", "prefix"])
    return found.groupBy("hk", "rp").agg(F.collect_list(F.struct(F.char_length("prefix").alias("length"), "verdict")).alias("open"))


def sweep(starts: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """stops with ``start``, that of the latest row of starts (.., start) not after it in the order of keys; null before the first."""
    spark, parts = stops.sparkSession, shuffle_partitions(stops.sparkSession)
    both = starts.withColumn("kind", F.lit(0)).unionByName(stops.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    placed = with_key_range(both, keys, parts)
    last = placed.where("kind = 0").groupBy("__range").agg(F.max_by("start", F.struct(*keys)).alias("start"))
    ranges = spark.range(parts).select(F.col("id").cast("int").alias("__range")).join(last, "__range", "left")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carry = ranges.select("__range", F.last("start", ignorenulls=True).over(before).alias("start"), F.lit(0).alias("kind"))  # null keys: first
    order = Window.partitionBy("__range").orderBy(*keys, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.unionByName(carry, allowMissingColumns=True).withColumn("start", F.last("start", ignorenulls=True).over(order))
    return swept.where("kind = 1").drop("kind", "__range")


def matches(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, path, best) of each of the different pairs (key, path) that a rule fits; best: (length, host_length, rule, verdict)."""
    at_hosts = stored(host_stacks(rules).select(F.col("hk").alias("key"), F.lit("").alias("path"), F.struct("hk", "open").alias("start")), "hosts")
    met = sweep(at_hosts, pairs, ["key", "path"])
    still = F.expr("filter(start.open, n -> startswith(key, left(start.hk, n)))")
    met = stored(met.select("key", "path", F.explode(still).alias("n")).select(F.expr("left(key, n)").alias("hk"), "path", "key"), "met")
    at_paths = path_stacks(rules).select("hk", F.col("rp").alias("path"), F.lit("").alias("key"), F.struct("hk", "rp", "open").alias("start"))
    met = sweep(stored(at_paths, "paths"), met, ["hk", "path", "key"]).where("start.hk = hk")
    met = met.withColumn("own", F.array_max(F.expr("filter(start.open, r -> startswith(path, left(start.rp, r.length)))"))).where("own is not null")
    rule = F.concat(host_of(F.col("hk")), F.expr("left(path, own.length)"))
    best = F.struct(F.char_length(rule).alias("length"), F.char_length("hk").alias("host_length"), rule.alias("rule"), F.col("own.verdict").alias("verdict"))
    return met.groupBy("key", "path").agg(F.max(best).alias("best"))


def filter_urls(df: DataFrame, rules: DataFrame | list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict (of the rule, else ``default``).

    rules: rows (verdict, host, path) of a table of any size, or a list.  The longest rule wins by characters of host and
    path, then of host; block wins over allow for the same rule.  One row for each row of df, repeated rows too; an empty
    table gives none.  Null, empty and malformed URLs get an empty host and path; URLs of any length are matched whole.
    Columns of df named like one of the new ones are replaced.  Sweeps see different URLs only, in ranges of equal size, so a
    hot host is many ranges; the rows meet what was found for their URL in a join of two tables that are written or read, which AQE
    can split where one URL is frequent.
    """
    spark = df.sparkSession
    host, path = host_and_path(F.col(url))
    keep = without(df, OUTPUT).columns
    urls = df.select(host.alias("host"), path.alias("path"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")).withColumn("__key", reversed_key(F.col("host")))
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, host string, path string")
    pairs = stored(urls.select(F.col("__key").alias("key"), "path").distinct(), "urls")
    best = stored(matches(pairs, stored(rule_table(given), "rules")), "matches").select(F.col("key").alias("__key"), "path", "best")
    out = urls.join(best, ["__key", "path"], "left")
    return out.select("__row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
