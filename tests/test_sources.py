import gzip
import random
import socket
import threading

import pytest
from pyspark.sql import functions as F

from quadrille.sources import files, generators
from quadrille.streaming import messages


def test_csv_with_nulls(spark, tmp_path):
    (tmp_path / "models.csv").write_text(",name,developer,experimental,max_sequence_length,batch_size,iteration_offset,approx_model_size\n0,a,X,True,4096,,,\n1,b,Y,False,2048,1024,0,13\n")
    rows = files.read_csv(spark, str(tmp_path / "models.csv"), files.MODELS).collect()
    assert [(r.name, r.experimental, r.batch_size, r.approx_model_size) for r in rows] == [("a", True, None, None), ("b", False, 1024, 13)]


def test_run_losses_take_the_model_from_the_file(spark, tmp_path):
    for m in ("m-1.8b", "m-13b"):
        (tmp_path / f"{m}.csv").write_text(",steps,loss\n0,1,9.5\n1,2,8.5\n")
    rows = files.read_run_losses(spark, [str(tmp_path / "m-1.8b.csv"), str(tmp_path / "m-13b.csv")])
    assert {r.model: r.n for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()} == {"m-1.8b": 2, "m-13b": 2}


def test_gzip_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "u.tsv.gz", "wt") as f:
        f.write("a\tb\tc\thttp://x/1\n\t\t\thttp://x/2\n")
    rows = files.numbered(files.read_tsv(spark, str(tmp_path / "u.tsv.gz"), 4), "_c3").collect()
    assert [(r["index"], r._c0, r._c3) for r in rows] == [(0, "a", "http://x/1"), (1, None, "http://x/2")]


def test_numbers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.5, -2.25), (1.0, 3.0)], "a double, b double")
    files.write_numbers(df, str(tmp_path / "n"), ["a", "b"])
    assert sorted(map(tuple, files.read_numbers(spark, str(tmp_path / "n"), ["a", "b"]).collect())) == [(0.5, -2.25), (1.0, 3.0)]


def test_jsonl_and_index_csv(spark, tmp_path):
    df = spark.createDataFrame([("é\n",), ("b",)], "text string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r.text for r in spark.read.schema("text string").json(str(tmp_path / "j")).collect()) == ["b", "é\n"]
    files.write_index_csv(spark.createDataFrame([(3.0,), (1.0,)], "loss double"), str(tmp_path / "c"), "loss")
    assert sorted(map(tuple, spark.read.schema("index long, loss double").option("header", True).csv(str(tmp_path / "c")).collect())) == [(0, 1.0), (1, 3.0)]


def test_override_and_settings(spark):
    table = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, p double")
    answers = spark.createDataFrame([(2, 9.0)], "id long, p double")
    assert files.override(table, None, "id", "p") is table
    assert {r.id: r.p for r in files.override(table, answers, "id", "p").collect()} == {1: 0.5, 2: 9.0}
    assert files.setting({"B": "2", "A": "1"}, "A", "B") == "1" and files.setting({}, "A") == "0"


def test_fetch_drops_empty_and_keeps_the_last(spark):
    urls = spark.createDataFrame([("http://a/x",), ("http://b/x",), ("http://b/y",)], "url string")
    got = files.fetch(urls, lambda u: b"" if u.endswith("y") else u.encode()).collect()
    assert [(r.url, r.name, bytes(r.content)) for r in got] == [("http://b/x", "x", b"http://b/x")]


def test_reports(spark):
    pairs = spark.createDataFrame([(k, k, k + 1, k / 4) for k in range(1, 12)], "rank long, i long, j long, dist2 double")
    assert [r["rank"] for r in files.rank_report(pairs).orderBy("rank").collect()] == [1, 10]
    members = spark.createDataFrame([(1, 5, 0.0, 0.0), (0, 6, 1.0, 1.0)], "k int, id long, x double, y double")
    centres = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.0, 0.0)], "k int, x double, y double")
    assert [(r.k, r.ord, r.id) for r in files.cluster_dump(members, centres).collect()] == [(0, 0, None), (0, 1, 6), (1, 0, None), (1, 1, 5)]


def test_generators(spark):
    state, rows = (5 << 16) + 0x330E, []
    for _ in range(20):
        state = (0x5DEECE66D * state + 0xB) % 2**48
        rows.append(state / 2**48)
    got = sorted(generators.drand48(spark, 10, ["x", "y"], seed=5).collect(), key=lambda r: r.id)
    assert [v for r in got for v in (r.x, r.y)] == rows
    assert generators.lcg_state(1, 0) == (1 << 16) + 0x330E
    blocks = generators.block_streams(spark, 500).agg(F.count("*"), F.count_distinct("id"), F.min("x"), F.max("y")).first()
    assert blocks[0] == blocks[1] == 500 and 0 <= blocks[2] and blocks[3] < 1
    assert generators.lattice(spark, 4).agg(F.sum("q")).first()[0] == 4
    assert generators.disc(spark, 50, 2.0).where("x * x + y * y > 4 or z <> 0").count() == 0
    keys = [r.key for r in generators.shuffled_keys(spark, 100).collect()]
    assert sorted(keys) == [k // 10 for k in range(100)] and keys != sorted(keys)
    assert [r.value for r in generators.indexed_fill(spark, 2, 2).orderBy("id").collect()] == [0, 1, 10, 11]
    assert generators.uniform(spark, 5, ["x"]).count() == 5


def test_tcp_stream(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))
    done = threading.Event()

    def serve():
        with server.accept()[0] as c:
            c.sendall(b"hello\nworld\n")
            done.wait(60)

    threading.Thread(target=serve, daemon=True).start()
    q = messages.tcp_lines(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("tcp_lines").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("tcp_lines").count() == 2:
                break
    finally:
        q.stop()
        done.set()
    assert sorted(r.value for r in spark.table("tcp_lines").collect()) == ["hello", "world"]


def test_udp_reader_replays_until_commit():
    port = random.randint(20000, 40000)
    reader = messages.UdpReader({"port": str(port), "wait": "0.3"})
    for m in (b"a", b"b"):
        messages.send_udp(m, "127.0.0.1", port)
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [("a",), ("b",)] and list(reader.readBetweenOffsets({"next": 1}, end)) == [("b",)]
    reader.commit(end)
    messages.send_udp(b"c", "127.0.0.1", port)
    rows, end = reader.read(end)
    assert list(rows) == [("c",)] and end == {"next": 3}
    reader.socket.close()


def test_stream_of_a_table_feeds_the_same_operator(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    counts = messages.table_stream(spark, str(tmp_path / "events"), events.schema).groupBy("event_type").agg(F.count("*").alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_type: r.n for r in spark.table("event_counts").collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_config_and_free_busy(spark):
    row = files.config_row(spark, {"trainer": {"devices": 8, "lr": 0.5}, "name": "a"}).first()
    assert row.trainer.devices == 8 and row.trainer.lr == 0.5 and row.name == "a"
    text = '{"calendars": {"c1": {"busy": [{"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T10:00:00+09:00"}]}, "c2": {"busy": []}}}'
    got = files.free_busy(spark.createDataFrame([(text,)], "value string")).selectExpr("cal", "unix_seconds(s) s", "unix_seconds(e) e").collect()
    assert [(r.cal, r.e - r.s) for r in got] == [("c1", 3600)]
    assert files.missing_columns(spark.range(1), "id", "_step") == ["_step"]


def test_contents_become_files(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1")), ("a", bytearray(b"2")), ("b", bytearray(b""))], "name string, content binary")
    files.write_contents(df, f"file://{tmp_path}/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a": b"2"}


def test_exponential_fill(spark):
    rows = generators.exponential_fill(spark, 100).orderBy("id").collect()
    assert rows[0].value == 1.0 and abs(rows[1].value - 23.140692) < 1e-4 and rows[99].value == float("inf")


def test_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# run\nmodel:\n  name: 'gpt'  # small\n  layers: 24\n  sizes:\n    - 1\n    - 2.5\noptim:\n  lr: 3.0e-4\n  mixed: true\nnone:\nlast: text with spaces\n")
    assert files.read_yaml(str(path)) == {"model": {"name": "gpt", "layers": 24, "sizes": [1, 2.5]}, "optim": {"lr": 3e-4, "mixed": True}, "none": None, "last": "text with spaces"}
    path.write_text("a: {b: 1}\n")
    with pytest.raises(ValueError):
        files.read_yaml(str(path))
    path.write_text("")
    assert files.read_yaml(str(path)) == {}


def test_lines_of_ascii_json(spark, tmp_path):
    import json

    texts = ["plain", "é ß 漢 🙂  ", "quote \" back \\ tab\t line\n", "", "}", "\x01"]
    files.write_jsonl(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), str(tmp_path / "a"))
    lines = [x for f in sorted((tmp_path / "a").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(json.loads(x)["text"] for x in lines) == sorted(texts) and all(x.isascii() for x in lines)


def test_positions_by_strings(spark):
    words = ["b", "a", "é", "", "aaaaaaaab", "aaaaaaaaa", "Z", "z" * 20]
    got = [r.w for r in files.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w").orderBy("index").collect()]
    assert got == sorted(words, key=lambda w: w.encode())


def test_generator_runs(spark):
    from quadrille.sources import generators as G

    x, plain = (7 << 16) + 0x330E, []
    for _ in range(1000):
        x = (G.A * x + G.C) % G.M
        plain.append(x)
    assert G.lcg_run(7, 0, 1000).tolist() == plain and G.lcg_run(7, 300, 50).tolist() == plain[300:350]
