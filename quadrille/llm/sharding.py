"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters the rows by a seeded hash into many small buckets; pass two shuffles each bucket by Fisher-Yates.
Buckets in order, each shuffled, are a uniform permutation of the rows (Rao, Sandelius); shards are equal cuts of it.
Both passes work on keys of the rows; a repeated row is one key with a number for each copy, so that its copies are
scattered like other rows and no bucket grows.  The texts cross the network once, to meet their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, fresh_path, numbered, row_hash, stored, without

#: Rows aimed at for one bucket.
BUCKET_ROWS = 256
ADDED = ("shard", "slot")


def fisher_yates(count: str, bucket: str, seed: int) -> F.Column:
    """A permutation of 0 .. count-1 drawn from (seed, bucket): Fisher-Yates, inside out."""
    draw = f"cast(pmod(xxhash64({seed}L, {bucket}, i), i + 1) as int)"
    put = "concat(slice(a, 1, j), array(i), slice(a, j + 2, i - j - 1), array(a[j]))"
    step = f"(a, i) -> element_at(transform(array({draw}), j -> case when j = i then array_append(a, i) else {put} end), 1)"
    return F.expr(f"aggregate(sequence(0, cast({count} as int) - 1), cast(array() as array<int>), {step})")


def places(keys: DataFrame, rows: int, seed: int, bucket_rows: int) -> DataFrame:
    """(h1, h2, piece, copies, pos): the places, 0 .. rows - 1, of the copies of each key."""
    buckets = max(1, -(-rows // bucket_rows))
    each = numbered(keys).withColumn("hash", F.xxhash64(F.lit(seed), "h1", "h2", "piece", "copy")).withColumn("bucket", F.pmod(F.col("hash"), F.lit(buckets)))
    counts = stored(each.groupBy("bucket").agg(F.count("*").alias("count")), "buckets").withColumn("super", F.expr("bucket div 1024"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    supers = counts.groupBy("super").agg(F.sum("count").alias("sum"))  # one row for 262,144 rows
    supers = supers.select("super", F.coalesce(F.sum("sum").over(before().orderBy("super")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("count").over(before("super").orderBy("bucket")), F.lit(0))
    dealt = counts.withColumn("own", own).join(supers, "super").select("bucket", (F.col("base") + F.col("own")).alias("offset"), fisher_yates("count", "bucket", seed).alias("perm"))
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "hash"), "hash", "h1", "h2", "piece", "copy")
    at = each.withColumn("at", F.row_number().over(order) - 1).join(dealt, "bucket")
    return at.select("h1", "h2", "piece", "copies", (F.col("offset") + F.get("perm", F.col("at"))).alias("pos"))


def assign(docs: DataFrame, shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with shard and slot by the law ``rows``: sizes of shards differ by one row at most, slots run from 0.

    Every row is placed once, repeated rows, rows of nulls and rows with maps too; an empty table gives no rows.  Columns of
    docs named shard or slot are replaced, others keep their names and values.  Texts of any length are one value of a row.
    The same rows and seed give the same shards, however they are partitioned.  Rows meet their places by two hashes of the
    whole row; a row that repeats is sent once from each partition.
    """
    keep = without(docs, ADDED)
    keyed = keep.select(row_hash(keep, seed).alias("h1"), row_hash(keep, seed, 1).alias("h2"), F.struct(*[F.col(f"`{c}`") for c in keep.columns]).alias("row"))
    keys = stored(keyed.groupBy("h1", "h2").agg(F.count("*").alias("copies")), "keys")
    known = keys.agg(F.sum("copies").alias("rows"), F.max("copies").alias("most")).first()
    rows = known.rows or 0
    placed = stored(places(keys, rows, seed, bucket_rows), "places")
    distinct = keyed.groupBy("h1", "h2").agg(F.first("row").alias("row"))
    at = distinct.join(placed.where(f"copies <= {PIECE}").select("h1", "h2", "pos").hint("merge"), ["h1", "h2"])
    if (known.most or 0) > PIECE:  # a hot row goes to as many tasks as it has pieces
        hot = placed.where(f"copies > {PIECE}").select("h1", "h2", "piece", "pos")
        few = keys.where(f"copies > {PIECE}").select("h1", "h2", "copies")
        pieces = keyed.join(few, ["h1", "h2"]).groupBy("h1", "h2", "copies").agg(F.first("row").alias("row"))
        pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}")))).drop("copies")
        at = at.unionByName(pieces.join(hot.hint("merge"), ["h1", "h2", "piece"]).select("h1", "h2", "row", "pos"))
    q, r = divmod(rows, shards)
    edge = r * (q + 1)
    at = at.withColumn("shard", F.expr(f"cast(case when pos < {edge} then pos div {q + 1} else {r} + (pos - {edge}) div {max(q, 1)} end as int)"))
    at = at.withColumn("slot", F.expr(f"pos - case when shard < {r} then shard * {q + 1}L else {edge}L + (shard - {r}) * {q}L end"))
    return at.select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 7) -> None:
    """Write ``path/shard=k`` in slot order within each file; Spark's committer makes a lost or repeated task harmless."""
    assign(docs, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 7, text: str = "text") -> DataFrame:
    """Write the shards, read them back, and describe each row by what the files hold."""
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed)
    back = docs.sparkSession.read.schema(without(docs, ADDED).withColumn("slot", F.lit(0).cast("long")).withColumn("shard", F.lit(0)).schema).parquet(path)
    utf8 = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    return back.select("doc_id", (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
