import base64
import gzip
import hashlib
import os

from quadrille.llm.warc import read_warc, record, write_warc

ROWS = [(1, "http://a/", "same", "x"), (2, "http://b/", "same", "x"), (3, None, "", "x"), (4, "http://c/\r\nWARC-Type: fake", None, "x"), (5, "http://é/", "é\r\n\r\nWARC/1.1\r\n" * 3, "x"), (None, "http://n/", "same", "x"), (None, "http://m/", "only null", "x"), (None, "http://m/", "only null", "x"), (6, "http://d/", "twice", "x"), (6, "http://d/", "twice", "x"), (7, "http://e/", "long " * 100_000, "x")]
SCHEMA = "page_id long, url string, html string, payload string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/out"
    manifest = write_warc(df, path, roll_bytes=300, shards=3)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS) and manifest.count() > 3
    back = read_warc(manifest, path).collect()
    key = lambda x: tuple(map(repr, x))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in back), key=key) == sorted(((i, len((h or "").encode()), digest(h)) for i, _, h, _ in ROWS), key=key)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest == digest("same")) for r in back), key=key)
    assert ((2, "response", None, True)) in kinds and (1, "revisit", 2, True) in kinds and (None, "revisit", 2, True) in kinds
    assert (4, "response", None, False) in kinds and (3, "revisit", 4, False) in kinds
    assert sorted(k for k in kinds if k[0] == 6) == [(6, "response", None, False), (6, "revisit", 6, False)]
    nulls = [r for r in back if r.payload_digest == digest("only null")]
    assert sorted(r.record_type for r in nulls) == ["response", "revisit"]
    assert {r.payload for r in back if r.page_id == 5} == {ROWS[4][2].encode()}
    names = sorted(os.listdir(tmp_path / "out"))
    assert "_temporary" not in names and sorted(r.name for r in manifest.collect()) == [n for n in names if n.endswith(".gz")]
    for r in manifest.collect():
        data = (tmp_path / "out" / r.name).read_bytes()
        assert hashlib.sha1(data).hexdigest() == r.sha1 and len(data) == r.bytes and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == r.records


def test_same_bytes_however_partitioned(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sums = []
    for k, part in enumerate((df.repartition(1), df.repartition(5, "url"))):
        sums.append({(r.name, r.sha1) for r in write_warc(part, f"file://{tmp_path}/{k}", roll_bytes=500, shards=4).collect()})
    assert sums[0] == sums[1]


def test_least_bytes_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:5], SCHEMA)
    path = f"file://{tmp_path}/a"
    assert {r.record_type for r in read_warc(write_warc(df, path, least_bytes=5), path).collect()} == {"response"}
    path = f"file://{tmp_path}/b"
    assert read_warc(write_warc(df.where("page_id = 0"), path), path).collect() == []


def test_frequent_payload_and_clashing_names(spark, tmp_path):
    rows = [(k, f"http://x/{k}", "empty page" if k % 4 else f"page {k}", "a", "b", "c") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, shard string, kind string").repartition(3)
    path = f"file://{tmp_path}/hot"
    back = {r.page_id: r for r in read_warc(write_warc(df, path), path).collect()}
    assert sorted(back) == list(range(400)) and all(back[k].payload_digest == digest(h) for k, _, h, *_ in rows)
    assert {(r.record_type, r.refers_to) for k, r in back.items() if k % 4 and k != 399} == {("revisit", 399)}
    assert {(r.record_type, r.refers_to) for k, r in back.items() if k % 4 == 0 or k == 399} == {("response", None)}


def test_record_is_deterministic():
    assert record(1, 0, "u", b"p", None, False) == record(1, 0, "u", b"p", None, False)
    text = gzip.decompress(record(1, 0, "http://x/\n", b"p", 9, True)).decode()
    assert "http://x/%0A\r\n" in text and "identical-payload-digest" in text and "WARC-Refers-To-Page-ID: 9" in text
