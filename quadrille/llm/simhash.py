"""SimHash near-dedup over a Gray-order hierarchical index.

The distinct fingerprints are sorted by Gray rank, where neighbours share long bit patterns, and cut into blocks of equal
size.  Blocks, and groups of blocks up to one root, are the upper nodes of one tree: a node holds the pattern (mask and
bits) that all fingerprints below it share.  Pairs of nodes descend from the root with the differences met so far; a level
adds the bits that its two patterns fix and those above left open, and a pair beyond the limit is dropped with everything
below it.  The upper levels are joins on the parents; a pair of blocks that is left goes down to its leaves in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, stored
from .local_sets import merge

BITS, LIMIT = 64, 3
#: Words hashed at a time; fingerprints in a leaf; children of a node; node pairs expanded at a time.
PIECE, LEAF, FAN, FRONT = 1 << 16, 2, 2, 1 << 16
#: Fingerprints of a block, the unit that travels (512 KB); children of a node above the blocks.
BLOCK, TOP_FAN = 1 << 16, 64
ONES = np.uint64(0x0101010101010101)


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64.

    A-Z are lowered; words are runs of anything but space and tab .. carriage return; shingles are ``width`` words with
    repeats, or the whole sequence where there are fewer; no word (or null) gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n, counts = max(1, len(words) - width + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        starts = np.arange(0, len(h), 255)  # a byte lane holds the count of so many
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & ONES, starts)
            counts[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp", width: int = 3) -> DataFrame:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, width) for x in texts], dtype="int64")

    return docs.withColumn(to, of(F.col(text)))


def gray_rank(c):
    """Position of c in Gray order: each bit is the parity of the bits from the top down to it."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def from_rank(key: np.ndarray) -> np.ndarray:
    """Fingerprints of Gray ranks that were stored with the sign bit turned, so that signed order is Gray order."""
    rank = key.view(np.uint64) ^ np.uint64(1 << 63)
    return rank ^ rank >> np.uint64(1)


class Tree:
    """Patterns (mask, bits) by level over fingerprints in Gray order; level 0 has the leaves, the last level one root."""

    def __init__(self, fp: np.ndarray, levels: int):
        self.fp, self.masks, self.bits = fp, [], []
        for k in range(levels):
            start = np.arange(0, len(fp), LEAF * FAN**k) if not k else np.arange(0, len(self.masks[-1]), FAN)
            both = np.bitwise_and.reduceat(fp if not k else self.both, start)
            some = np.bitwise_or.reduceat(fp if not k else self.some, start)
            self.both, self.some = both, some
            self.masks.append(both | ~some)
            self.bits.append(both)


def tree_links(fp: np.ndarray, other: np.ndarray | None = None, limit: int = LIMIT, seen: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of fp, j of other) within limit bits, both in Gray order; without other, pairs i < j of fp.

    seen counts pairs of nodes and of fingerprints that were looked at, and of nodes that were dropped.
    """
    same, levels = other is None, 1
    while LEAF * FAN ** (levels - 1) < max(len(fp), 0 if same else len(other)):
        levels += 1
    one = Tree(fp, levels)
    two = one if same else Tree(other, levels)
    root = np.zeros(1, np.int64)
    stack = [(levels - 1, root, root, *descend(one, two, levels - 1, root, root, np.zeros(1, np.uint64), np.zeros(1, np.uint8)))]
    while stack:
        level, a, b, mask, diff = stack.pop()
        if len(a) > FRONT:
            stack += [(level, a[k : k + FRONT], b[k : k + FRONT], mask[k : k + FRONT], diff[k : k + FRONT]) for k in range(0, len(a), FRONT)]
            continue
        fan = FAN if level else LEAF
        ends = (len(one.masks[level - 1]), len(two.masks[level - 1])) if level else (len(one.fp), len(two.fp))
        x = (a[:, None] * fan + np.repeat(np.arange(fan), fan)).ravel()
        y = (b[:, None] * fan + np.tile(np.arange(fan), fan)).ravel()
        at = (x < ends[0]) & (y < ends[1])
        if same:
            at &= x <= y if level else x < y
        at = np.flatnonzero(at)
        x, y, up = x[at], y[at], at // (fan * fan)
        if level:
            mask, diff = descend(one, two, level - 1, x, y, mask[up], diff[up])
        else:
            diff = diff[up] + np.bitwise_count(~mask[up] & (one.fp[x] ^ two.fp[y]))
        near = np.flatnonzero(diff <= limit)
        if seen is not None:
            seen["nodes" if level else "fingerprints"] += len(x)
            seen["dropped"] += (len(x) - len(near)) * bool(level)
        if level and len(near):
            stack.append((level - 1, x[near], y[near], mask[near], diff[near]))
        elif len(near):
            yield x[near], y[near]


def descend(one: Tree, two: Tree, level: int, x: np.ndarray, y: np.ndarray, mask: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joint mask, differences so far) of pairs of nodes, from those of the pairs above them: only open bits are new."""
    joint = one.masks[level][x] & two.masks[level][y]
    return joint, diff + np.bitwise_count(joint & ~mask & (one.bits[level][x] ^ two.bits[level][y]))


def _search(group: pa.Table) -> pa.Table:
    """Spanning edges of the links between two blocks, or within one."""
    keys = [from_rank(k.values.to_numpy()) for k in group.column("keys")]
    one, two = keys[0], keys[1] if len(keys) > 1 else None
    both, shift = np.concatenate(keys), len(one) if two is not None else 0
    labels = np.arange(len(both))
    for i, j in tree_links(one, two):
        labels = merge(labels, i, j + shift)
    at = np.flatnonzero(labels != np.arange(len(both)))
    return pa.table([pa.array(both[at].view(np.int64)), pa.array(both[labels[at]].view(np.int64))], names=["u", "v"])


def block_pairs(blocks: DataFrame, count: int) -> DataFrame:
    """(a, b), a <= b, of the blocks whose patterns leave room for a link: pairs of nodes descend level by level."""
    both, levels = blocks.select("block", "both", "some"), 0
    while TOP_FAN**levels < count:
        levels += 1
    pairs = blocks.sparkSession.createDataFrame([(0, 0, 0, 0)], "a long, b long, mask long, diff int")
    for k in reversed(range(levels)):
        size = TOP_FAN**k
        nodes = both.groupBy(F.expr(f"block div {size}").alias("id")).agg(F.bit_and("both").alias("both"), F.bit_or("some").alias("some"))
        nodes = nodes.select("id", F.expr(f"id div {TOP_FAN}").alias("up"), F.expr("both | ~some").alias("mask"), F.col("both").alias("bits"))
        x, y = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in "xy")
        met = pairs.join(x, F.col("a") == F.col("x_up")).join(y, F.col("b") == F.col("y_up")).where("x_id <= y_id")
        met = met.withColumn("joint", F.expr("x_mask & y_mask")).withColumn("diff", F.expr("diff + bit_count(joint & ~mask & (x_bits ^ y_bits))"))
        pairs = met.where(F.col("diff") <= LIMIT).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.col("joint").alias("mask"), "diff")
    return pairs.select("a", "b")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Spanning edges (u, v) of all links among the distinct fingerprints of ``prints`` (fp).

    A block goes to every block that its pattern may link with: of N blocks of evenly spread fingerprints those that
    differ in 3 of the leading log2(N) bits or fewer.
    """
    count = prints.count()
    keys = prints.select(gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(2**63))).alias("key"), "fp")
    parts = max(1, -(-count // (16 * BLOCK)))
    placed = keys.repartitionByRange(parts, "key").sortWithinPartitions("key").select("key", "fp", F.monotonically_increasing_id().alias("id"))
    placed = stored(placed, "ranked")
    part, nth = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a row for a million fingerprints
    before = np.cumsum([0, *(sizes.get(k, 0) for k in range(max(sizes, default=0)))]).tolist()
    block = F.floor((F.get(F.lit(before).cast("array<long>"), part.cast("int")) + nth) / F.lit(BLOCK)).alias("block")
    cells = placed.groupBy(block).agg(F.sort_array(F.collect_list("key")).alias("keys"), F.bit_and("fp").alias("both"), F.bit_or("fp").alias("some"))
    blocks = stored(cells, "blocks")
    pairs = stored(block_pairs(blocks, -(-count // BLOCK)), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return sides.join(blocks.select("block", "keys"), "block").groupBy("a", "b").applyInArrow(_search, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash, fp, root, component_id) of each row of docs; component_id: the smallest id that links can reach.

    Links join fingerprints of 3 differing bits or fewer; root is a fingerprint that names the component, hash one that
    names the text.  Null and empty texts have fingerprint 0 and link like any other; rows of equal text or repeated rows
    share a fingerprint; null ids are kept, and count only where a component has no other id.  A very long text is hashed
    whole, in pieces of PIECE words.  Other columns aren't read, whatever their names.  An empty table gives no rows.
    """
    prints = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    prints = cut(prints.select("doc_id", F.xxhash64("text").alias("hash"), "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = cut(connected_components(fingerprint_links(distinct)))
    named = distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(named.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "hash", "fp", "root", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less all but one row of each component: the one of the smallest id stays, with all its columns.

    Of texts that share that id the one of the least hash stays, and of rows that repeat id and text any one; null is the
    largest id.  Null, empty and very long texts as in components().  Columns keep their names, those that clash with names
    used here too.  An empty table gives no rows.
    """
    if clash := [c for c in docs.columns if c.lower() in ("__id", "__hash")]:
        kept = dedup(docs.withColumnsRenamed({c: f"{c}_own" for c in clash}), doc_id, text)
        return kept.withColumnsRenamed({f"{c}_own": c for c in clash})
    found = components(docs, doc_id, text).groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    found = found.withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    first = cut(found.groupBy("root").agg(F.min("rank").alias("first")))
    judged = cut(found.join(first, "root").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "n", (F.col("rank") == F.col("first")).alias("stays")))
    # The list grows with the documents: they meet by a shuffle at every size.
    goes = judged.where("not stays or n > 1").select("__id", "__hash")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    kept = docs.join(goes.hint("merge"), same, "left_anti")
    repeated = judged.where("stays and n > 1").select("__id", "__hash")
    if not repeated.isEmpty():
        again = docs.join(stored(repeated, "repeated"), same, "left_semi").withColumn("__hash", F.xxhash64(text))
        kept = kept.unionByName(again.dropDuplicates([doc_id, "__hash"]).drop("__hash"))
    return kept


def hex16(c):
    return F.lpad(F.lower(F.hex(c)), 16, "0")
