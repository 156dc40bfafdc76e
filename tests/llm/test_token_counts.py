import pytest

from quadrille.llm.queries import VOCABULARY
from quadrille.llm.token_counts import encoding, section_tokens

with open(VOCABULARY, "rb") as file:
    CODER = encoding(file.read())


def plain(text, rule):
    """Sections by hand; each token's bytes walked one by one."""
    data = (text or "").encode()
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, x in enumerate(lines) for _ in x]
    counts, crossing, at = [0.0] * len(lines), [0] * len(lines), 0
    for token in CODER.encode_ordinary(text or ""):
        own = owner[at : at + len(CODER.decode_single_token_bytes(token))]
        at += len(own)
        crossing[own[0]] += own[0] != own[-1]
        for k in own:
            counts[k] += 1 / len(own) if rule == "split" else 0
        if rule != "split":
            counts[own[0] if rule == "start" else own[-1]] += 1
    assert at == len(data)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.decode()))
    return [(k, starts[k], starts[k + 1], round(counts[k], 9), crossing[k]) for k in range(len(lines))]


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", " \n \n two  \n\n\nthree", "été\r\nß漢字🙂\n🙂", "a b\n" * 500, "x" * 20_000 + "\n" + "y", "tail\n\n\n\n  end"]


@pytest.mark.parametrize("rule", ["start", "end", "split"])
def test_against_every_byte(spark, rule):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, TEXTS[6], None), (4, TEXTS[4], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, section string")
    got = section_tokens(df, VOCABULARY, rule=rule).collect()
    want = [(i, *x) for i, t, _ in rows for x in plain(t, rule)]
    assert sorted((repr(r.doc_id), r.section, r.start, r.end, round(r.n_tokens, 9), r.n_crossing) for r in got) == sorted((repr(x[0]), *x[1:]) for x in want)
    assert rule != "start" or sum(r.n_crossing for r in got) > 0


def test_whole_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: r["sum(n_tokens)"] for r in section_tokens(docs, VOCABULARY).groupBy("doc_id").sum("n_tokens").collect()}
    assert got == {r.doc_id: len(CODER.encode_ordinary(r.text)) for r in docs.collect()}


def test_empty_table_and_bad_rule(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert section_tokens(empty, VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        section_tokens(empty, VOCABULARY, rule="none")
