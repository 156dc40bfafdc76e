import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quadrille.llm.packing import LENGTHS, OVERHEAD, best_fit, pack, word_tokens


def plain(sizes):
    """The same rules, looking at every open bin and every later piece."""
    bins = []
    for k, size in enumerate(sizes):
        room = [(c - sum(own), n) for n, (c, own) in enumerate(bins) if c - sum(own) >= size]
        if room:
            least = min(r for r, _ in room)
            bins[next(n for r, n in room if r == least)][1].append(size)
            continue

        def cost(c, size=size, k=k):
            return (c + OVERHEAD) / (size + min(c - size, sum(s for s in sizes[k + 1 :] if s <= c - size)))

        bins.append((min((c for c in LENGTHS if c >= size), key=cost), [size]))
    return sorted((min(c for c in LENGTHS if c >= sum(own)), sum(own)) for _, own in bins)


def test_best_fit_against_plain_rules():
    rng = random.Random(0)
    for n in (0, 1, 5, 60, 200):
        sizes = sorted((rng.choice([rng.randint(1, 600), rng.randint(1, 8192)]) for _ in range(n)), reverse=True)
        bins, offsets, size, used = best_fit(np.array(sizes, int))
        assert sorted(zip(size, used, strict=True)) == plain(sizes)
        by = defaultdict(list)
        for b, o, s in zip(bins, offsets, sizes, strict=True):
            by[b].append((o, s))
        for b, own in by.items():
            ends = np.cumsum([s for _, s in sorted(own)])
            assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] == used[b] <= size[b]


def check(rows, lengths):
    """Every token of every row has one place; bins are as small as permitted, and their pieces lie side by side."""
    bins, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        docs[r.doc_id] += r.n_tokens
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None and r.bin_size is None
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_used for r in own} == {at} and {r.bin_size for r in own} == {min(c for c in lengths if c >= at)}
    return docs, bins


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = pack(docs.select("doc_id", "text"), word_tokens(F.col("text"))).collect()
    tokens, bins = check(rows, LENGTHS)
    assert tokens == {r.doc_id: len(r.text.split()) + 1 for r in docs.collect()}
    used, size = sum(b[0].bin_used for b in bins.values()), sum(b[0].bin_size for b in bins.values())
    assert used / size > 0.95


def plain_places(pieces):
    """{(doc_id, start): (bin_id, bin_size, bin_used, offset)} of one group of (doc_id, start, size), by the rules as stated."""
    pieces = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    bins, filled, at = [], [], {}
    for k, (doc, start, size) in enumerate(pieces):
        fits = [(c - sum(own), -filled[n], n) for n, (c, own) in enumerate(bins) if c - sum(own) >= size]
        if fits:
            n = min(fits)[2]  # least room; of equal room the one filled last
        else:
            later = [p[2] for p in pieces[k + 1 :]]
            n = len(bins)
            bins.append((min((c for c in LENGTHS if c >= size), key=lambda c, size=size, later=later: (c + OVERHEAD) / (size + min(c - size, sum(s for s in later if s <= c - size)))), []))
            filled.append(0)
        at[doc, start] = (n, sum(bins[n][1]))
        bins[n][1].append(size)
        filled[n] = k
    used = [sum(own) for _, own in bins]
    return {p: (f"0-{n}", min(c for c in LENGTHS if c >= used[n]), used[n], offset) for p, (n, offset) in at.items()}


def test_whole_table_against_plain_places(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    pieces = []
    for r in docs.collect():
        n = len(r.text.split()) + 1
        pieces += [(r.doc_id, s, min(8192, n - s)) for s in range(0, n, 8192)]
    got = {(r.doc_id, r.start): (r.bin_id, r.bin_size, r.bin_used, r.bin_offset) for r in pack(docs, word_tokens(F.col("text"))).collect()}
    assert got == plain_places(pieces)


def test_equal_sizes_go_by_id(spark):
    rows = [(k, 300 if k % 2 else 200) for k in (9, 3, 7, 1, 8, 2, 6, 4, 5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(4)
    got = {(r.doc_id, r.start): (r.bin_id, r.bin_size, r.bin_used, r.bin_offset) for r in pack(df, F.col("n")).collect()}
    assert got == plain_places([(k, 0, n) for k, n in rows])
    places = sorted((got[k, 0][0], got[k, 0][3]) for k in (1, 3, 5, 7, 9))
    assert [(got[k, 0][0], got[k, 0][3]) for k in (1, 3, 5, 7, 9)] == places


def test_edge_rows(spark):
    rows = [(1, 0, "x"), (2, None, "x"), (3, 8192, "x"), (4, 8193, "x"), (5, 1_000_000, "x"), (None, 7, "x"), (None, 7, "x"), (6, 10, "x")] + [(7, 5, "x")] * 500
    df = spark.createDataFrame(rows, "doc_id long, n long, bin_id string")
    out = pack(df, F.col("n"), group=64).collect()
    tokens, _ = check(out, LENGTHS)
    assert tokens == {1: 0, 2: 0, 3: 8192, 4: 8193, 5: 1_000_000, None: 14, 6: 10, 7: 2500}
    whole = sorted((r.start, r.n_tokens) for r in out if r.doc_id == 5)
    assert whole == [(k * 8192, min(8192, 1_000_000 - k * 8192)) for k in range(123)]
    assert pack(df.where("doc_id = -1"), F.col("n")).collect() == []


def test_long_text_and_word_rule(spark):
    df = spark.createDataFrame([(1, "w\x0b" * 20_000), (2, " \t"), (3, None), (4, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.n for r in df.select("doc_id", word_tokens(F.col("text")).alias("n")).collect()} == {1: 20_001, 2: 0, 3: 0, 4: 3}
