import hashlib
import random
import re

from quadrille.llm.decontaminate import benchmark_items, clean, fingerprints, item_fingerprints, report, word_hashes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    spans = []
    for item, text in items:
        w = words(text)
        if item is not None and w:
            n = min(13, len(w))
            spans += [(str(item), tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, s in spans:
            for p in range(len(w) - len(s) + 1):
                if tuple(w[p : p + len(s)]) == s:
                    hit |= set(range(p, p + len(s)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, hash string, w string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in report(d, b).collect()), key=repr), d, b


def fixture():
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "d3", "été", "ß"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([40, 13, 14, 12, 5, 3, 200])] + [(7, ""), (8, None), (9, " - "), (None, "alpha beta"), (1, "another passage of the very same item " * 3), (10, "été-été_été")]
    docs = [(k, text(n), None, None, None) for k, n in enumerate([0, 1, 3, 12, 13, 30, 300, 3000])]
    for k, (_, passage) in enumerate(items[:7]):
        docs.append((100 + k, f"{text(10)} {passage.upper() if passage.isascii() else passage}! {text(25)}", "x", "y", "z"))
        docs.append((200 + k, f"{text(10)}\n{' '.join(passage.split()[:13])}, {text(600)}", None, None, None))
    docs += [(300, None, None, None, None), (301, "", None, None, None), (302, "?!", None, None, None), docs[8], docs[8], (None, docs[8][1], None, None, None), (100, docs[10][1], None, None, None)]
    return docs, items


def test_against_every_window(spark):
    docs, items = fixture()
    rows, d, b = got(spark, docs, items)
    want = plain(docs, items)
    assert rows == want and sum(r[5] for r in rows) > 5
    bad = {r[:1] for r in want if r[5]}
    kept = clean(d, b)
    assert kept.columns == d.columns
    texts = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert texts == sorted(repr((x[0], x[1])) for x in docs if not plain([x], items)[0][5]) and bad


def test_empty_tables(spark):
    docs, items = fixture()
    assert got(spark, [], items)[0] == []
    assert got(spark, docs[:4], [])[0] == plain(docs[:4], [])


def test_every_shared_span_has_a_fingerprint(spark):
    """Any 13 words have a fingerprint that the whole text has at the same place; there are far fewer than windows."""
    rng = random.Random(1)
    for letters in ("ab", "abcdefghijkl", "a"):
        text = [rng.choice(letters) for _ in range(120)]
        parts = [(0, " ".join(text))] + [(k + 1, " ".join(text[k : k + 13])) for k in range(108)]
        df = spark.createDataFrame(parts, "item_id long, text string")
        rows = fingerprints(df.select("item_id", word_hashes(df.text).alias("w"))).collect()
        whole = {(r.p, r.f) for r in rows if r.item_id == 0}
        for k in range(108):
            assert any((r.p + k, r.f) in whole for r in rows if r.item_id == k + 1)
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(2012)))], "item_id long, text string")
    assert 500 < item_fingerprints(benchmark_items(df)[0]).count() < 650  # of 2000 windows; 2 in W + 1 expected


def test_large_benchmarks_meet_by_shuffles(spark, monkeypatch):
    import quadrille.llm.decontaminate as D

    docs, items = fixture()
    monkeypatch.setattr(D, "BROADCAST_PRINTS", 0)
    assert got(spark, docs, items)[0] == plain(docs, items)
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    assert got(spark, docs, items)[0] == plain(docs, items)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3)], "doc_id long, text string, __id int, __hash int, __hit int")
    kept = clean(docs, spark.createDataFrame([(1, "x y")], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.collect() == docs.collect()


def test_native_plan(spark, tiny):
    from quadrille.llm.queries import op4_decontamination

    plan = op4_decontamination(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
