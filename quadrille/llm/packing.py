"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are packed in falling order into the open bin that they leave the least room in.  Where none has room, a new bin
opens at the permitted length of least cost for what it can be expected to hold: all lengths are weighed jointly, each by
its cost over the volume of this and the later pieces that still fit.  At the end a bin shrinks to the smallest
permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, numbered, stored

#: Permitted lengths; the cost of a bin is its length and OVERHEAD; pieces packed together, which bounds a task's memory.
LENGTHS, OVERHEAD, GROUP = (512, 1024, 2048, 4096, 8192), 32, 4096
ADDED = "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_size long, bin_used long, bin_offset long"


def word_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` and one end mark; nothing for a text that is null or has no word."""
    n = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return F.when(n > 0, n + 1).otherwise(n)


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int], list[int]]:
    """For sizes in falling order: (bin of each, offset of each, size of each bin, contents of each bin)."""
    lengths = tuple(sorted(lengths))
    rising = np.sort(sizes)
    volume = np.concatenate([[0], np.cumsum(rising)]).tolist()
    rising = rising.tolist()
    room: dict[int, list[int]] = {}  # bins by what is left in them
    rooms: list[int] = []  # its keys, rising
    bins, offsets, opened, used = [], [], [], []
    for k, size in enumerate(sizes.tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            later = len(rising) - k - 1  # pieces after this one are rising[:later]

            def unit_cost(c: int, size=size, later=later) -> float:
                fits = min(bisect_left(rising, c - size + 1), later)
                return (c + overhead) / (size + min(c - size, volume[fits]))

            left = min((c for c in lengths if c >= size), key=unit_cost)
            b = len(opened)
            opened.append(left)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if (left := left - size) > 0:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append(b)
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used], used


def pack(docs: DataFrame, n_tokens: Column, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_size, bin_used, bin_offset): where each piece of each row lies.

    A row longer than the largest length, however long, is cut into pieces of that length and a rest; every token has one
    place.  A row of no (or null) tokens comes back once, with null bin columns.  Repeated rows and null ids are packed like
    others: they are counted, numbered and dealt apart.  Pieces are dealt to groups by a hash, and each group is packed
    alone; of pieces of equal size the one of the smaller id goes first, and of bins with equal room the one filled last is
    taken.  Other columns aren't read, whatever their names.  An empty table gives no rows.
    """
    longest = max(lengths)
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    counts = stored(counts, "counts")  # the texts are read once
    each = numbered(counts).select("doc_id", "n", (F.col("piece") * PIECE + F.col("copy")).alias("copy"))
    empty = each.where("n = 0").selectExpr("doc_id", "0L piece", "0L start", "0L n_tokens", "cast(null as string) bin_id", "cast(null as long) bin_size", "cast(null as long) bin_used", "cast(null as long) bin_offset")
    pieces = each.where("n > 0").select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("long").alias("size"))
    total = counts.agg(F.sum(F.expr(f"copies * ((n + {longest - 1}) div {longest})"))).first()[0] or 0
    groups = max(1, -(-total // group))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)))

    def packed(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "doc_id", "piece", "copy"], ascending=[False, True, True, True])
        bins, offsets, size, used = best_fit(x["size"].to_numpy(), lengths, overhead)
        bins = np.array(bins)
        names = f"{x.group.iloc[0]}-" + pd.Series(bins).astype(str)
        return pd.DataFrame({"doc_id": x.doc_id.array, "piece": x.piece.array, "start": x.start.array, "n_tokens": x["size"].array, "bin_id": names.array, "bin_size": np.array(size)[bins], "bin_used": np.array(used)[bins], "bin_offset": offsets})

    return pieces.groupBy("group").applyInPandas(packed, ADDED).unionByName(empty)
