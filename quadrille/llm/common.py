"""Shared helpers: inputs, the shared folder, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, fresh_path, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of one row that a task numbers in one go.
PIECE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: like cut(), but with sizes that the planner knows."""
    path, schema = fresh_path(df.sparkSession, what), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-case A-Z only.  lower() is the same thing for pure ASCII, and much faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_hash(df: DataFrame, *salt: int):
    """64-bit hash of a whole row.  Columns that hold a map, which Spark doesn't hash, count by their JSON."""
    whole = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[F.lit(x) for x in salt], *[whole(f) for f in df.schema.fields])


def numbered(keys: DataFrame) -> DataFrame:
    """keys (.., copies) as one row for each copy: piece, and copy within it from 0.  Pieces of a hot key are dealt apart."""
    few = keys.where(f"copies <= {PIECE}").withColumn("piece", F.lit(0).cast("long")).withColumn("here", F.col("copies").cast("int"))
    many = keys.where(f"copies > {PIECE}").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}"))))
    many = many.withColumn("here", F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE).cast("int")).repartition(*keys.columns, "piece")
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("here") - 1))).drop("here")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge list (u, v): component is the smallest node that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes, each cut with a checkpoint.
    The joins read two materialised sides, so that AQE can split a hub that holds a large part of the edges;
    all aggregates are partial minima.  Only nodes that have an edge come back; an empty list gives no rows.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    old = state(e)
    for _ in range(max_rounds if old[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = state(e)
        if new == old:  # a forest of stars stays as it is
            break
        old = new
    else:
        if old[0]:
            raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
