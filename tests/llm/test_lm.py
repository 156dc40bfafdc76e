import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import lm


def tokens(text):
    return [*bytes(text or "", "utf-8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split(), b""]


def part(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def plain(rows):
    taught = [tokens(t) for i, t, *_ in rows if i is not None and part(i) != 2]
    count = Counter(w for t in taught for w in t)
    n, v = sum(count.values()), len(count)
    out = []
    for i, t, *_ in rows:
        w = tokens(t)
        out.append((i, part(i) == 2, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=repr)


def short(r):
    return (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))


@pytest.fixture(scope="module")
def scored(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    return docs.collect(), lm.score(docs).collect()


def test_counts_and_base(scored):
    rows, got = scored
    assert sorted(map(short, got), key=repr) == plain([(r.doc_id, r.text) for r in rows])


def test_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored[1] if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in held)


def test_mixture_by_hand(spark, monkeypatch):
    """Scores from plain counts, with the weights that were learned; and they are probabilities."""
    learned = {}
    original = lm.learn
    monkeypatch.setattr(lm, "learn", lambda cells, uniform: learned.setdefault("w", original(cells, uniform)))
    rows = [(k, f"the cat sat on the {'mat' if k % 3 else 'dog'} w{k % 5}") for k in range(60)] + [(61, None), (62, ""), (None, "the cat")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = learned["w"]
    taught = [tokens(t) for i, t in rows if i is not None and part(i) != 2]
    count, pairs = Counter(x for t in taught for x in t), Counter(p for t in taught for p in zip([None, *t], t, strict=False))
    context = count | Counter({None: len(taught)})
    n, v = sum(count.values()), len(count)

    def p(a, x):
        c = context[a]
        weights = w[0 if not c else min(int(math.log2(c)) + 1, lm.CLASSES - 1)]
        return weights[0] * pairs[a, x] / max(c, 1) + weights[1] * count[x] / n + weights[2] / (v + 1)

    for i, t in rows:
        words = tokens(t)
        want = sum(math.log10(p(a, x)) for a, x in zip([None, *words], words, strict=False))
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want))
    for a in [None, b"the", b"", b"unseen"]:
        if a != b"":
            assert abs(sum(p(a, x) for x in [*count, b"never"]) - 1) < 1e-9


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 50)
    rows = [(k, t, "clash") for k, t in enumerate(["", None, " \t\n", "a", "A a\x0bA", "b " * 30_000, "é É"])] + [(3, "a", "clash"), (3, "a", "clash"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    assert sorted(map(short, lm.score(df).collect()), key=repr) == plain(rows)
    assert lm.score(spark.createDataFrame([], df.schema)).collect() == []


def test_weights_favour_what_held_out_tokens_need():
    w = lm.learn([(5, 0.9, 0.01, 100.0), (2, 0.0, 0.2, 100.0)], 1e-4)
    assert w[5][0] > 0.9 and w[2][1] > 0.9 and np.allclose(w.sum(1), 1) and w[0][0] == 0
    assert np.allclose(lm.learn([], 0.1).sum(1), 1)


def test_blobs():
    x = np.array([0, 1, 2**63, 5], np.uint64)
    assert (lm.expand(lm.squeeze(x)) == x).all() and len(lm.expand(lm.squeeze(x[:0]))) == 0


def test_em_recomputed(spark, tiny, monkeypatch):
    """The weights are those of EM over every held-out token, with counts taken from the rest in plain Python."""
    learned, original = {}, lm.learn
    monkeypatch.setattr(lm, "learn", lambda cells, uniform: learned.setdefault("w", original(cells, uniform)))
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    lm.score(docs)
    taught = [(part(r.doc_id), tokens(r.text)) for r in docs.collect() if part(r.doc_id) != 2]
    main, dev = [t for k, t in taught if k != lm.DEV], [t for k, t in taught if k == lm.DEV]
    count, pairs = Counter(x for t in main for x in t), Counter(p for t in main for p in zip([None, *t], t, strict=False))
    context, n, distinct = count + Counter({None: len(main)}), sum(count.values()), len({x for _, t in taught for x in t})
    rows = []
    for t in dev:
        for a, x in zip([None, *t], t, strict=False):
            c = context[a]
            rows.append((0 if not c else min(int(math.log2(c)) + 1, lm.CLASSES - 1), pairs[a, x] / max(c, 1), count[x] / n))
    rows = np.array(rows)
    for k in set(rows[:, 0].astype(int).tolist()):
        own = np.column_stack([rows[rows[:, 0] == k, 1:], np.full((rows[:, 0] == k).sum(), 1 / (distinct + 1))])
        w = np.array([0, 0.5, 0.5]) if k == 0 else np.full(3, 1 / 3)
        for _ in range(3000):
            got = own * w
            w = (got / got.sum(1, keepdims=True)).mean(0)
        assert np.abs(learned["w"][k] - w).max() < 0.02, (k, learned["w"][k], w)
