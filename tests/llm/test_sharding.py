import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.llm.common import PIECE, row_hash
from quadrille.llm.sharding import assign, fisher_yates, shard_digest


def check_law(rows, n, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes.get(k, 0)))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 1000])
def test_law_of_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(9).alias("shard"))
    rows = assign(df, 16, bucket_rows=32).collect()
    check_law(rows, n, 16)
    assert sorted(r.doc_id for r in rows) == list(range(n))


def test_same_rows_same_shards_however_partitioned(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    a = {(r.doc_id, r.shard, r.slot) for r in assign(docs, 7).collect()}
    b = {(r.doc_id, r.shard, r.slot) for r in assign(docs.repartition(11, "text"), 7).collect()}
    assert a == b and a != {(r.doc_id, r.shard, r.slot) for r in assign(docs, 7, seed=8).collect()}


def test_fisher_yates(spark):
    rows = spark.range(3000).select(F.col("id"), F.lit(4).alias("n")).withColumn("p", fisher_yates("n", "id", 3)).collect()
    seen = Counter(tuple(r.p) for r in rows)
    assert all(sorted(p) == [0, 1, 2, 3] for p in seen) and len(seen) == 24
    assert sum((v - 125) ** 2 / 125 for v in seen.values()) < 60  # chi-square with 23 degrees of freedom


def test_edge_rows(spark):
    rows = [(None, None, "a"), (None, None, "a"), (1, "", "b"), (1, "é" * 50_000, "c"), (2, "x", None)] + [(7, "copy", "d")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = shard_digest(df, 4).collect()
    check_law(got, len(rows), 4)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_many_repeats_of_one_row(spark):
    df = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    check_law(assign(df, 3, bucket_rows=64).collect(), 5000, 3)


def placed_plainly(rows, shards, seed, bucket_rows):
    """The same placement in plain Python, from each row's two hashes: {(h1, h2): [(shard, slot) of its copies]}."""
    keys = Counter(rows)
    each = [(h1, h2, n // PIECE, n % PIECE) for (h1, h2), c in keys.items() for n in range(c)]
    buckets = max(1, -(-len(rows) // bucket_rows))
    member = {}
    for x in each:
        h = xx(seed, *[long(v) for v in x[:3]], x[3])
        member.setdefault(h % buckets, []).append((xx(seed + 1, long(h)), h, *x))
    order, out = [], {}
    for b in sorted(member):
        rows_here, perm = sorted(member[b]), []
        for i in range(len(rows_here)):
            j = xx(long(seed), long(b), i) % (i + 1)
            perm = [*perm[:j], i, *perm[j + 1 :], perm[j]] if j < i else [*perm, i]
        base = len(order)
        order += [None] * len(rows_here)
        for x, p in zip(rows_here, perm, strict=True):
            order[base + p] = x[2:4]
    q, r = divmod(len(rows), shards)
    sizes = [q + (k < r) for k in range(shards)]
    at = ((k, s) for k, n in enumerate(sizes) for s in range(n))
    for key, place in zip(order, at, strict=True):
        out.setdefault(key, []).append(place)
    return {k: sorted(v) for k, v in out.items()}


class long(int):  # noqa: N801
    """A 64-bit column, which hashes unlike a 32-bit one."""


def xx(*values):
    """Spark's xxhash64 of some int and long columns: each value's hash seeds the next; signed."""
    h = 42
    for v in values:
        h = xxhash_value(v, h)
    return h - 2**64 if h >= 2**63 else h


def xxhash_value(v, seed):
    m = 2**64 - 1
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    rot = lambda x, k: (x << k | x >> 64 - k) & m
    if isinstance(v, long):
        h = (seed + p5 + 8) & m
        h ^= rot((v & m) * p2 & m, 31) * p1 & m
        h = (rot(h, 27) * p1 + p4) & m
    else:
        h = (seed + p5 + 4) & m
        h ^= (v & 0xFFFFFFFF) * p1 & m
        h = (rot(h, 23) * p2 + p3) & m
    h ^= h >> 33
    h = h * p2 & m
    h ^= h >> 29
    h = h * p3 & m
    return h ^ h >> 32


def test_against_a_plain_placement(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 3").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("k"))
    got = assign(docs, 5, seed=3, bucket_rows=64)
    hashed = got.select(row_hash(docs, 3).alias("h1"), row_hash(docs, 3, 1).alias("h2"), "shard", "slot").collect()
    found = {}
    for r in hashed:
        found.setdefault((r.h1, r.h2), []).append((r.shard, r.slot))
    want = placed_plainly([(r.h1, r.h2) for r in hashed], 5, 3, 64)
    assert {k: sorted(v) for k, v in found.items()} == want and max(map(len, want.values())) > PIECE


def test_copies_of_a_hot_row_are_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.range(6000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    rows = assign(df, 10).collect()
    check_law(rows, 9000, 10)
    hot = Counter(r.shard for r in rows if r.doc_id == -1)
    assert sum(hot.values()) == 6000 and all(520 < hot[k] < 680 for k in range(10))


def test_map_columns(spark):
    df = spark.range(20).select("id", F.create_map(F.lit("a"), F.col("id")).alias("m"), F.struct(F.create_map(F.lit(1), F.lit(2)).alias("x")).alias("s"))
    assert sorted(r.m["a"] for r in assign(df, 3).collect()) == list(range(20))


def test_native_plan(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    plan = assign(docs, 16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
