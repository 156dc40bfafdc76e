import random
from collections import Counter

import numpy as np
import xxhash

from quadrille.llm.common import connected_components
from quadrille.llm.simhash import components, dedup, gray_rank, hex16, simhash, tree_links


def plain(text):
    words = [w for w in bytes(text or "", "utf-8").translate(bytes(range(256)).lower()).replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints):
    root = {i: i for i in range(len(prints))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in [None, "", " \t", "one", "A b", "A b C d", "É é\x0bÀ x\x0cy", "a b a b a b a b", "w " * 70_000 + "end"]:
        assert simhash(text) % 2**64 == plain(text)


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain(t) for _, t in rows]
    low = [rows[k][0] for k in classes(prints)]
    got = components(docs).select("doc_id", hex16("fp").alias("fp"), "component_id").collect()
    assert sorted((r.doc_id, r.fp, r.component_id) for r in got) == [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, low, strict=True)]


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (None, " ", "x"), (8, "Some words of text", "y"), (8, "Some words of text", "y"), (9, "some WORDS of text", "y"), (None, "quite another sentence", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in components(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, 3), (3, 3), (None, 3), (8, 8), (8, 8), (9, 8), (None, None)], key=repr)
    kept = dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.fp) for r in kept.collect()), key=repr) == sorted([(3, "x"), (8, "y"), (None, "z")], key=repr)
    empty = spark.createDataFrame([], df.schema)
    assert components(empty).collect() == [] and dedup(empty).collect() == []


def ranks(x):
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(k)
    return x


def near_group(rng, n, flips):
    base = rng.integers(0, 2**63, dtype=np.uint64)
    out = np.full(n, base)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 48, n).astype(np.uint64)
    return out


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    fp = np.unique(np.concatenate([near_group(rng, 300, 4), near_group(rng, 300, 2), rng.integers(0, 2**63, 700, dtype=np.uint64)]))
    fp = fp[np.argsort(ranks(fp))]
    got = {(i, j) for a, b in tree_links(fp) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 3, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_links_between_two_trees():
    rng = np.random.default_rng(2)
    fp = np.unique(np.concatenate([near_group(rng, 400, 2), rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    fp = fp[np.argsort(ranks(fp))]
    for cut in (1, 300, len(fp) - 1):
        got = {(i, j + cut) for a, b in tree_links(fp[:cut], fp[cut:]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.nonzero(np.bitwise_count(fp[:cut, None] ^ fp[cut:]) <= 3)
        assert got == set(zip(i.tolist(), (j + cut).tolist(), strict=True))


def test_the_tree_prunes_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fp = np.array(sorted({simhash(r.text) % 2**64 for r in docs.select("text").collect()}), np.uint64)
    fp = fp[np.argsort(ranks(fp))]
    seen = Counter()
    got = {(i, j) for a, b in tree_links(fp, seen=seen) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 3, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))
    assert seen["nodes"] and seen["dropped"] > 0.1 * seen["nodes"] and seen["fingerprints"] < 0.05 * len(fp) ** 2 / 2


def test_blocks_lose_no_link(spark, monkeypatch):
    """Many small blocks, three levels of nodes above them, and a group that is larger than a block."""
    import quadrille.llm.simhash as S

    monkeypatch.setattr(S, "BLOCK", 20)
    monkeypatch.setattr(S, "TOP_FAN", 3)
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([near_group(rng, 150, 3), rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {r.node: r.component for r in connected_components(S.fingerprint_links(df)).collect()}
    want = classes([int(x) for x in fp])
    groups = {}
    for k, f in zip(want, fp.view(np.int64).tolist(), strict=True):
        groups.setdefault(k, set()).add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(2, "some words of text", 1, 2), (1, "some WORDS of text", 3, 4)], "doc_id long, text string, __id int, __hash int")
    kept = dedup(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "some WORDS of text", 3, 4)]


def test_gray_rank_orders_the_gray_code(spark):
    codes = [k ^ k >> 1 for k in range(64)]
    random.Random(4).shuffle(codes)
    df = spark.createDataFrame([(c,) for c in codes], "c long")
    assert {r.c: r.r for r in df.select("c", gray_rank(df.c).alias("r")).collect()} == {k ^ k >> 1: k for k in range(64)}


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (5000, 4000), (5000, 4000)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(200)} | {5000: 4000, 4000: 4000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
