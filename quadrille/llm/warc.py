"""Deterministic sharded WARC writer, and a reader.

Records are sorted by page id and digest and cut into shards at bounds that follow from the rows alone; a task writes one
shard as gzip members (one a record) into files that roll at a compressed size.  Headers and digests are made anew.  A task
writes under a temporary name of its own attempt; only files named by the stored manifest are renamed and exist for
readers, so a lost, repeated or speculative task leaves nothing but a temporary file.

Payloads cross the network once.  What is known of copies, found on digests, travels as rows that sort before the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import search
from .common import stored

#: Compressed bytes at which a file is closed; bytes of payload and headers aimed at for a shard, and shards at most (larger
#: inputs have larger shards); bound samples taken for each shard; bytes that a record has besides its payload.
ROLL_BYTES, SHARD_BYTES, SHARDS, SAMPLES, HEAD_BYTES = 256 << 20, 32 << 20, 1 << 16, 16, 600
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(text: str) -> str:
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own; the same arguments give the same bytes."""
    name = lambda page, nth: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{nth}').urn}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id, copy), "WARC-Date": DATE}
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI"] = header_value(url)
    head["WARC-Payload-Digest"] = f"sha1:{base32_sha1(payload)}"
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to, 0)}
        if refers_to is not None:
            head["WARC-Refers-To-Page-ID"] = str(refers_to)
    head |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class Roll:
    """The file being written, under its temporary name."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, part: int, attempt: int):
        self.shard, self.part, self.name = shard, part, f"shard-{shard:05d}-{part:05d}.warc.gz"
        self.temporary = f"_temporary/{attempt}-{self.name}"
        self.out = store.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.records, self.bytes, self.digest = 0, 0, hashlib.sha1()

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        self.digest.update(member)

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "part": self.part, "temporary": self.temporary, "name": self.name, "records": self.records, "bytes": self.bytes, "sha1": self.digest.hexdigest()}


def shard_bounds(groups: DataFrame, shard_bytes: float) -> list[tuple[int, int]]:
    """Keys (place, mark) at which shards end.  groups: place, mark, weight, with each key once.

    A key is in the sample if its hash is below its share of bytes: a sample for each SAMPLES-th of a shard, the same for
    the same rows, SAMPLES * SHARDS keys on the driver at most (as far as hashes are even).
    """
    dice = F.pmod(F.xxhash64("place", "mark"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sorted(tuple(r) for r in groups.where(dice < F.col("weight") * (SAMPLES / shard_bytes)).select("place", "mark").collect())
    return drawn[SAMPLES::SAMPLES]


def shard_of(bounds: list[tuple[int, int]]):
    """How many of the bounds are at or before (place, mark)."""
    places, marks = (F.lit([x[k] for x in bounds]) if bounds else None for k in (0, 1))
    return search(len(bounds), lambda k: (F.get(places, k) < F.col("place")) | ((F.get(places, k) == F.col("place")) & (F.get(marks, k) <= F.col("mark"))))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives under path; returns the manifest, a row for each file.

    Of records with equal payloads of at least ``least_bytes`` the one of the largest page_id is a response, the others
    revisit it.  Null html is an empty payload, a null url leaves its header out, a null page_id sorts first and is the
    largest only among nulls.  Of rows that repeat page_id and payload, which share a shard, the first is the response.
    A record is built whole in memory, so the largest payload must fit a task some five times.  Other columns aren't
    written, whatever their names.  An empty table gives no file.  shards: how many to aim at, if not by bytes.
    """
    spark: SparkSession = pages.sparkSession
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    placed = lambda df: df.withColumns({"place": F.coalesce("page_id", F.lit(-(1 << 63))), "mark": F.xxhash64("digest")})
    size = F.octet_length("payload")
    groups = stored(rows.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.first(size).cast("long").alias("bytes")), "digests")
    total = groups.agg(F.sum(F.col("n") * (F.col("bytes") + HEAD_BYTES))).first()[0] or 0
    shard_bytes = total / shards if shards else max(SHARD_BYTES, total / SHARDS)
    bounds = shard_bounds(placed(groups).withColumn("weight", F.col("n") * (F.col("bytes") + HEAD_BYTES)), shard_bytes or 1)
    copies = groups.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.sum("n").alias("all")).where("all > 1").select("digest", "first")
    told = groups.select("page_id", "digest").join(stored(copies, "copies"), "digest")  # stored, so that a frequent digest can be split
    both = rows.withColumn("kind", F.lit(1)).unionByName(told.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = placed(both).withColumn("shard", shard_of(bounds)).select("shard", "page_id", "digest", "kind", "url", "payload", "first")
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(f"{folder}/_temporary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, copied, nth, done = None, None, None, 0, []
        attempt = TaskContext.get().taskAttemptId()
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for k in range(batch.num_rows):
                x = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                key = (x["shard"], x["page_id"], x["digest"])
                if not x["kind"]:
                    copied, first = key, x["first"]
                    continue
                nth, last = (nth + 1 if key == last else 0), key
                if out and (out.shard != x["shard"] or out.bytes >= roll_bytes):
                    done.append(out.close())
                    out = Roll(store, folder, x["shard"], out.part + 1 if out.shard == x["shard"] else 0, attempt)
                out = out or Roll(store, folder, x["shard"], 0, attempt)
                revisit = copied == key and (x["page_id"] != first or nth > 0)
                out.add(record(x["page_id"], nth, x["url"], x["payload"], first if revisit else None, revisit))
        if out:
            done.append(out.close())
        names = ["shard", "part", "temporary", "name", "records", "bytes", "sha1"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types, strict=True)], names=names)

    dealt = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = stored(dealt.mapInArrow(write, MANIFEST), "manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for x in batch.to_pylist():
                if store.get_file_info(f"{folder}/{x['name']}").type == fs.FileType.NotFound:  # else a lost task had come so far
                    store.move(f"{folder}/{x['temporary']}", f"{folder}/{x['name']}")
            yield batch

    manifest.mapInArrow(rename, MANIFEST).write.parquet(f"{path}/_manifest")
    store.delete_dir(f"{folder}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def parse(stream) -> Iterator[dict]:
    """Records of an open archive, one at a time; raises where a digest doesn't hold."""
    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := data.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            block = data.read(int(head["content-length"]))
            if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"block digest of {head['warc-record-id']}")
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
            if kind == "response" and (length != len(payload) or digest != base32_sha1(payload)):
                raise ValueError(f"payload of {head['warc-record-id']}")
            number = lambda k, h=head: int(h[k]) if k in h else None
            yield {"page_id": number("warc-page-id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "url": head.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """One row for each record of the files in the manifest, in a task for each file; payload null for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for x in parse(stream):
                        rows.append(x)
                        held += len(x["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("name").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
