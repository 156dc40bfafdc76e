import corpus_pipeline
from quadrille.llm import langid
from quadrille.llm.queries import op4_decontamination

from .test_decontaminate import plain as hits
from .test_packing import check
from .test_simhash import classes, plain


def test_whole_pipeline_against_plain_python(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = langid.fit(docs)
    rows = [(i, t) for i, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= 0.5]
    root = classes([plain(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    bad = {x[0] for x in hits(rows, items) if x[5]}
    want = {i: len(t.split()) + 1 for i, t in rows if i not in bad}
    tokens, _ = check(corpus_pipeline.run(spark, tiny).collect(), (512, 1024, 2048, 4096, 8192))
    assert tokens == want and bad and len(want) < docs.count()


def test_stages_keep_the_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny).schema == docs.schema
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_queries_are_registered(spark, tiny):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert op4_decontamination(spark, tiny).count() == 200


def odd_documents(spark, tiny):
    """Documents with nulls, empty and very long texts, repeats and columns of clashing names."""
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    long = " ".join(f"word{k} the house and that man" for k in range(20_000))
    told = [(k, f"the {w} in the house and that man was {w}ing with the {w}", "en", f"s{k}", 1, 9, 9, 9, 9) for k, w in enumerate(["cat", "dog", "bird", "fish", "horse"] * 2)]
    odd = [(None, "the quite other text of no id and that is all in the house", None), (50, None, "en"), (51, "", "en"), (52, "12 !", None), (53, long, "en"), (54, f"the house {item}", "en")]
    return spark.createDataFrame(told + [(*x, None, None, 9, 9, 9, 9) for x in odd + odd[-2:]], "doc_id long, text string, lang string, source string, n_chars long, __id int, __hash int, __hit int, __language int")


def test_stages_on_odd_rows(spark, tiny):
    stage, docs = dict(corpus_pipeline.STAGES), odd_documents(spark, tiny)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    told = stage["language_id"](spark, docs, tiny)
    assert told.columns == docs.columns and ids(told) == sorted([*range(10), 53, 53, 54, 54, None], key=repr)
    one = stage["simhash_dedup"](spark, docs, tiny)
    assert one.columns == docs.columns and ids(one) == sorted([0, 1, 2, 3, 4, 50, 52, 53, 54, None], key=repr)
    clean = stage["decontamination"](spark, docs, tiny)
    assert clean.columns == docs.columns and ids(clean) == sorted([*range(10), 50, 51, 52, 53, 53, None], key=repr)
    packed = stage["best_fit_packing"](spark, docs, tiny)
    assert packed.where("bin_id is null").count() == 2 and packed.where("doc_id = 53").agg({"n_tokens": "sum"}).first()[0] == 2 * (20_000 * 6 + 1)
