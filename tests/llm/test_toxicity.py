import zlib

import numpy as np

from quadrille.llm import queries as Q
from quadrille.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int, quality int"


def found(text, stems=None):
    names = {T.INSULT: "insult", T.MILD: "mild", T.THREAT: "threat"}
    got = T.matches(text, T.Lexicon({"idiot": 1.0, "meh": 0.4} if stems is None else stems))
    return {(names[k], c): round(x, 3) for (k, c), x in zip(T.PATTERNS, got, strict=True) if x}


def test_patterns_of_clauses():
    assert found("You are an idiot.") == {("insult", "directed"): 1.0}
    assert found("What an idiot") == {("insult", "plain"): 1.0} == found("IDIOTS everywhere")
    assert found("You are not an idiot") == {("insult", "negated"): 1.0}
    assert found("You are not at all what they took for an idiot") == {("insult", "directed"): 1.0}  # beyond the reach of "not"
    assert found("He said you are an idiot") == {("insult", "reported"): 1.0}
    assert found('The word "idiot" is old, idiot') == {("insult", "reported"): 1.0, ("insult", "plain"): 1.0}
    assert found("I will kill you") == {("threat", "directed"): 1.0} == found("you: nothing. I will hurt them")
    assert found("kill the process") == {} and found("I will not kill you") == {("threat", "negated"): 1.0}
    assert found("He said nothing. Idiot!") == {("insult", "plain"): 1.0}  # another clause
    assert found("meh, idiot") == {("mild", "plain"): 0.4, ("insult", "plain"): 1.0}
    assert found(None) == found("") == found("... 123 🙂") == found("you are kind") == {}


def test_composition_equals_one_after_the_other():
    alphabet = [(k, "plain") for k in range(T.OTHER + 1)]
    swap = T.Transducer({(0, alphabet[0]): (1, alphabet[1]), (1, alphabet[0]): (0, alphabet[2])})
    mark = T.Transducer({(0, alphabet[1]): (0, (1, "x")), (0, alphabet[2]): (1, (2, "y")), (1, alphabet[1]): (1, (1, "z"))})
    both, rng = swap.then(mark, alphabet), np.random.default_rng(0)
    for _ in range(50):
        s1 = s2 = s = 0
        for k in rng.integers(0, 4, 12):
            s1, middle = swap.step(s1, alphabet[k])
            s2, want = mark.step(s2, middle)
            s, out = both.step(s, alphabet[k])
            assert out == want


def test_weights_are_the_likeliest():
    rng = np.random.default_rng(1)
    x = T.features(rng.integers(0, 3, (40, len(T.PATTERNS))).astype(float))
    toxic, clean = rng.integers(0, 5, 40).astype(float), rng.integers(0, 5, 40).astype(float)
    w = T.fitted(x, toxic, clean)
    a = np.column_stack([np.ones(40), x])
    p = 1 / (1 + np.exp(-a @ w))
    assert np.abs(a.T @ (toxic - (toxic + clean) * p) - (w - T.prior()) / T.PRIOR_SPREAD**2).max() < 1e-6


def corpus(n=900):
    """Made-up words; each third document is toxic by three words of two unlisted stems."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "ka", "shu"], rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(40)], int(k % 3 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["grobnak", "vexil"])) + word())
        rows.append((k, " ".join(words), "x"))
        labels.append((k, toxic, 1))
    return rows, labels


def test_learns_stems_from_labels_and_only_from_its_fold(spark):
    rows, labels = corpus()
    docs, model = spark.createDataFrame(rows, DOCS), None
    model = T.fit(docs, spark.createDataFrame(labels, LABELS))
    assert {"grobnak", "vexil"} <= set(model.stems)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for k, toxic, _ in labels:
        assert (got[k] >= T.TOXIC) == bool(toxic), k
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    flipped = [(k, 1 - toxic if k in held else toxic, q) for k, toxic, q in labels]
    again = T.fit(docs, spark.createDataFrame(flipped, LABELS))
    assert again.stems == model.stems and np.allclose(again.weights, model.weights)
    drawn = T.fit(docs, spark.createDataFrame(labels, LABELS), sample=300)
    assert {"grobnak", "vexil"} <= set(drawn.stems)


def test_copies_of_a_passage_teach_no_words(spark):
    rows, labels = corpus(300)
    copy = "harmless passage about gardens of zorblat that occurs again and again"
    rows += [(1000 + k, copy, "x") for k in range(60)]
    labels += [(1000 + k, 1, 1) for k in range(60)]
    model = T.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert not any("zorblat".startswith(s) or "gardens".startswith(s) for s in model.stems)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (3, "you idiot " * 20000, "x"), (3, "fine", "x"), (3, "fine", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, 1), (3, 1, 1), (3, 0, 1), (9, 1, 1)], LABELS)
    for model in (T.fit(docs, labels), T.fit(docs, labels.where("false")), T.fit(docs.where("false"), labels)):
        got = T.score(docs, model)
        assert got.columns == ["doc_id", "text", "score"] and dict(got.dtypes)["score"] == "double"
        scores = [(r.doc_id, r.score) for r in got.collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for _, s in scores) and scores[0][1] == scores[1][1] == scores[4][1] < T.TOXIC <= scores[2][1]
        assert T.score(docs.where("false"), model).collect() == []


def test_query_finds_held_out_insults(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.QUERIES["op13_toxicity"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sorted(got) == sorted(d.doc_id for d in docs)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for k, r in got.items())
    english = [d.doc_id for d in docs if d.lang == "en" and d.doc_id in labels and got[d.doc_id].held_out]
    toxic, clean = ([k for k in english if labels[k] == y] for y in (1, 0))
    assert sum(got[k].predicted for k in toxic) >= 0.9 * len(toxic) and sum(got[k].predicted for k in clean) <= 0.01 * len(clean) and len(toxic) > 10
