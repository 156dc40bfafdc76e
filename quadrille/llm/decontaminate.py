"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of every W consecutive k-grams of a text the one of the least hash is a fingerprint (the leftmost, where hashes are equal),
so texts that share WINDOW = K + W - 1 words share a fingerprint there (Schleimer, Wilkerson, Aiken, 2003).  Documents and
items meet on fingerprints alone; a meeting is extended word by word to both sides, W - 1 words at most, and is a hit
where WINDOW words or more agree.  A longer span is covered by the hits of its fingerprints, which are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, stored

K, W = 8, 6
WINDOW, REACH = K + W - 1, W - 1
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same, and what a word is, before A-Z are lowered.
SEPARATOR_ANY, WORD_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark up to which they are broadcast with their words (some 250 bytes each), and up to which
#: their hashes are (some 20 bytes each), so that only documents' fingerprints that meet one are shuffled.
BROADCAST_PRINTS, BROADCAST_HASHES = 50_000, 1_000_000
#: Names used beside the columns of a caller.
OWN = ("__id", "__hash", "__hit")


def word_hashes(text: Column) -> Column:
    """Hashes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.transform(F.array_remove(F.split(F.lower(text), SEPARATOR), ""), lambda w: F.xxhash64(w))
    mixed = F.transform(F.array_remove(F.split(text, SEPARATOR_ANY), ""), lambda w: F.xxhash64(ascii_lower(w)))
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(mixed)


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR_ANY), "")).cast("long")


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairwise(x: Column, shift: int, of) -> Column:
    """of(x[k], x[k + shift]) for each k that has both."""
    n = F.size(x) - shift
    return F.zip_with(F.slice(x, 1, n), F.slice(x, shift + 1, n), of)


def grams(w: Column) -> Column:
    """Hashes of each K consecutive word hashes, from those of 2, 4 and 8."""
    mix = lambda x, y: F.xxhash64(x, y)
    return bound(bound(pairwise(w, 1, mix), lambda x: pairwise(x, 2, mix)), lambda x: pairwise(x, 4, mix))


def minima(h: Column) -> Column:
    """Places of the leftmost least of each W consecutive values of h, each once; h has W values or more.

    Values are compared by their leading 33 bits and their place, so equal ones take the leftmost.
    """
    lesser = lambda x, y: F.when(x < y, x).otherwise(y)
    of_six = lambda two, four: F.zip_with(F.slice(four, 1, F.size(four) - 2), F.slice(two, 5, F.size(four) - 2), lesser)
    placed = F.transform(h, lambda x, k: x.bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(k.cast("long")))
    least = bound(placed, lambda x: bound(pairwise(x, 1, lesser), lambda two: bound(pairwise(two, 2, lesser), lambda four: of_six(two, four))))
    return F.array_distinct(least)


def fingerprints(df: DataFrame) -> DataFrame:
    """df (w: word hashes, others) as one row for each fingerprint: p and f, its place and hash, beside all columns."""
    own = df.withColumn("grams", F.when(F.size("w") >= WINDOW, grams(F.col("w"))))
    # Not explode(), for which Spark infers a filter that would work out all minima once more.
    own = own.withColumn("p", F.explode_outer(minima(F.col("grams")))).where("p is not null")
    return own.withColumn("p", F.col("p").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).withColumn("f", F.get("grams", F.col("p"))).drop("grams")


def around() -> Column:
    """The word hashes that a fingerprint may be extended to; null beyond the text."""
    return F.transform(F.sequence(F.lit(-REACH), F.lit(K + REACH - 1)), lambda k: F.get("w", F.col("p") + k))


def agreeing(first: int, count: int, step: int) -> Column:
    """How many of ``count`` places, from ``first`` on by ``step``, hold equal words here and there; null is no word."""
    same = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.coalesce(F.get("here", first + step * k) == F.get("there", first + step * k), F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.when(at == 0, count).otherwise(at - 1)


def short_windows(w: Column, n: int) -> Column:
    """(p, len, f) of each n < WINDOW consecutive words: windows of items so short are compared whole."""
    def window(p):
        return F.struct(p.alias("p"), F.lit(n).alias("len"), F.xxhash64(F.lit(n), F.slice(w, p + 1, n)).alias("f"))

    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), window))


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item, w) of the items that have an id and a word, and which lengths under WINDOW there are."""
    items = cut(benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), word_hashes(F.col("text")).alias("w")).where("size(w) > 0"))
    return items, sorted(r.n for r in items.select(F.size("w").alias("n")).where(f"n < {WINDOW}").distinct().collect())  # 12 lengths at most


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(f, there, items) of each different fingerprint with its surroundings."""
    return fingerprints(items).groupBy("f", around().alias("there")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def met(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, hash, p, len, items) of each stretch around a fingerprint that agrees on WINDOW words or more."""
    prints = cut(prints)
    each, size = fingerprints(docs), prints.count()
    if size <= BROADCAST_PRINTS:
        each = each.join(F.broadcast(prints), "f").withColumn("here", around())
    else:
        if size <= BROADCAST_HASHES:
            each = each.join(F.broadcast(prints.select("f").distinct()), "f", "left_semi")
        each = each.select("doc_id", "hash", "p", "f", around().alias("here")).join(prints, "f")  # a frequent fingerprint is split by AQE
    each = each.select("doc_id", "hash", "p", "items", agreeing(REACH - 1, REACH, -1).alias("left"), agreeing(REACH, K + REACH, 1).alias("right"))
    each = each.withColumn("len", F.col("left") + F.col("right")).where((F.col("right") >= K) & (F.col("len") >= WINDOW))
    return each.select("doc_id", "hash", (F.col("p") - F.col("left")).alias("p"), "len", "items")


def met_whole(docs: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """The same for items of fewer than WINDOW words."""
    own = F.lit(None).cast("array<struct<p:int,len:int,f:bigint>>")
    for n in short:
        own = F.when(F.size("w") == n, short_windows(F.col("w"), n)).otherwise(own)
    there = items.select("item", F.explode(own).alias("x")).select("item", "x.len", "x.f")
    there = cut(there.groupBy("len", "f").agg(F.array_sort(F.collect_set("item")).alias("items")))
    if there.count() <= BROADCAST_PRINTS:
        there = F.broadcast(there)
    none = F.array().cast("array<struct<p:int,len:int,f:bigint>>")
    each = docs.select("doc_id", "hash", F.explode(F.concat(*[F.coalesce(short_windows(F.col("w"), n), none) for n in short])).alias("x"))
    return each.select("doc_id", "hash", "x.*").join(there, ["len", "f"]).select("doc_id", "hash", "p", "len", "items")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, hash, n_hit, items) of each different row of docs (doc_id, text) that holds a window of the benchmark."""
    items, short = benchmark_items(benchmark)
    docs = docs.select("doc_id", F.xxhash64(text).alias("hash"), word_hashes(F.col(text)).alias("w"))
    each = met(docs, item_fingerprints(items))
    if short:
        each = each.unionByName(met_whole(docs, items, short))
    spans = each.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set(F.struct("p", "len"))).alias("spans"), F.collect_set("items").alias("sets"))
    covered = "aggregate(spans, struct(0L as upto, 0L as n), (a, s) -> struct(greatest(a.upto, s.p + s.len) as upto, a.n + greatest(0L, s.p + s.len - greatest(a.upto, cast(s.p as long))) as n), a -> a.n)"
    return cut(spans.select("doc_id", "hash", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    Null and empty texts have no words and no hits.  Repeated rows and rows of one text are each reported; an id may be
    null or repeated.  Items without words or without an id are no items; items that repeat an id are one item.  Very long
    texts are one array of hashes in one task, 8 bytes a word.  Other columns aren't read, whatever their names.  No
    documents, no rows; no items, no hits.
    """
    found = hits(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), "n_hit", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), count_words(F.col("text")).alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less the contaminated rows: those with a hit where a twentieth of the words or more is hit.

    Rows, texts and items as in report(); what stays keeps all its columns, also those that clash with names used here.
    """
    if clash := [c for c in docs.columns if c.lower() in OWN]:
        return clean(docs.withColumnsRenamed({c: f"{c}_own" for c in clash}), benchmark).withColumnsRenamed({f"{c}_own": c for c in clash})
    found = hits(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("n_hit").alias("__hit"))
    found = stored(found, "hits")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    bad = docs.select("doc_id", "text").join(found, same).where(20 * F.col("__hit") >= count_words(F.col("text")))
    bad = stored(bad.select("__id", "__hash").distinct(), "contaminated")
    return docs.join(bad, same, "left_anti")
