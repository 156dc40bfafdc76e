"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram, the unigram and a uniform share, by weights that depend on
how often the context was seen; the weights are learned by expectation-maximisation on counts of a held-out part.

Counts of all tokens and token pairs are looked up in bulk.  Each task tokenises its rows in chunks and sends the chunk's
different keys, sorted, once to the key's bucket; the bucket sums them over all chunks and answers each in its order.
So a frequent word costs one key a chunk, no key is hot, and no table of counts is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .langid import remainder

#: crc32(doc_id) mod 7 of documents that nothing is learned from, and of those whose counts train the mixture weights.
HELD_OUT, DEV = 2, 5
#: Tokens in a chunk; bytes of text for each bucket; classes of context frequency (by powers of two); EM rounds at most,
#: and the change of a weight under which they end; bytes of text for a partition of the cells, which every round reads.
CHUNK, BUCKET_BYTES, CLASSES, ROUNDS, SETTLED, CELL_BYTES = 1 << 18, 8 << 20, 48, 200, 1e-3, 64 << 20
BOS, END = np.uint64(1), np.uint64(xxhash.xxh64_intdigest(b"", 7))


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z, then of one end mark."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(b"")
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(31) | b >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return x ^ x >> np.uint64(32)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed byte planes of an integer array."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Chunk:
    """Tokens of some documents, with their different words and word pairs, both sorted by key."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None):
        self.starts = starts
        self.words, self.word = (words, tokens) if words is not None else np.unique(tokens, return_inverse=True)
        before = np.r_[0, self.word[:-1] + 1]
        before[starts] = 0
        self.before, wide = before, len(self.words) + 1
        codes, pair = np.unique(before * wide + self.word, return_inverse=True)
        keys = pair_key(np.r_[BOS, self.words][codes // wide], self.words[codes % wide])
        order = np.argsort(keys)
        self.pairs, rank = keys[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[pair]

    def requests(self, taught: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, keys, counts in taught documents); words go to the first buckets, pairs to as many more."""
        weight = np.repeat(taught, np.diff(np.r_[self.starts, len(self.word)])).astype(float)
        edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
        for base, keys, at in ((0, self.words, self.word), (buckets, self.pairs, self.pair)):
            counts = np.bincount(at, weight, len(keys)).astype(np.uint64)
            cut = np.r_[np.searchsorted(keys, edges), len(keys)]
            for k in np.flatnonzero(np.diff(cut)):
                yield base + int(k), keys[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]


def chunks(batches: Iterator[pa.RecordBatch], only_dev: bool = False) -> Iterator[tuple[str, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, ids, remainders, tokens, starts), documents of DEV apart from the others, in the order of the rows."""
    task, nth = TaskContext.get().partitionId(), {True: 0, False: 0}
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def close(dev: bool):
        rows, name = held[dev], f"{task}-{'dev' if dev else 'main'}-{nth[dev]}"
        held[dev], size[dev], nth[dev] = [], 0, nth[dev] + 1
        starts = np.cumsum([0, *(len(x[2]) for x in rows[:-1])])
        return name, [x[0] for x in rows], np.array([x[1] for x in rows]), np.concatenate([x[2] for x in rows]), starts

    for batch in batches:
        for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            dev = part == DEV
            if only_dev and not dev:
                continue
            tokens = tokens_of(text.as_py())
            held[dev].append((doc_id, -1 if part is None else part, tokens))
            size[dev] += len(tokens)
            if size[dev] >= CHUNK:
                yield close(dev)
    for dev in (True, False):
        if held[dev]:
            yield close(dev)


def table(schema: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


REQUEST = [("bucket", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())]
ANSWER = [("chunk", pa.string()), ("bucket", pa.int32()), ("main", pa.binary()), ("dev", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()), ("total_main", pa.int64())]
CHUNKED = [("chunk", pa.string()), ("bucket", pa.int32()), ("main", pa.binary()), ("dev", pa.binary()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))]
SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
DDL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}


def ddl(schema: list[tuple]) -> str:
    return ", ".join(f"{n} {DDL[t]}" for n, t in schema)


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, parts, tokens, starts in chunks(batches):
            taught = (parts >= 0) & (parts != HELD_OUT)
            rows = [(b, name, squeeze(np.diff(k, prepend=np.uint64(0))), squeeze(c)) for b, k, c in Chunk(tokens, starts).requests(taught, buckets)]
            yield table(REQUEST, rows)

    return ask


def _answer(buckets: int):
    def answer(group: pa.Table) -> pa.Table:
        names, bucket = group.column("chunk").to_pylist(), group.column("bucket")[0].as_py()
        keys = [np.cumsum(expand(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([expand(c) for c in group.column("counts").to_pylist()]).astype(float)  # exact up to 2**53
        dev = np.repeat(["-dev-" in n for n in names], [len(k) for k in keys])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        main, held = np.bincount(at, counts * ~dev).astype(np.uint64), np.bincount(at, counts * dev).astype(np.uint64)
        both = main + held
        cut = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(n, bucket, squeeze(main[x]), squeeze(held[x]), None, None, None) for n, x in zip(names, np.split(at, cut), strict=True)]
        if bucket < buckets:
            rows.append((None, bucket, None, None, int((both > 0).sum()), int(both.sum()), int(main.sum())))
        return pa.Table.from_batches([table(ANSWER, rows)])

    return answer


def _payload(only_dev: bool):
    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, parts, tokens, starts in chunks(batches, only_dev):
            words, word = np.unique(tokens, return_inverse=True)
            blob = zstandard.compress(word.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
            lengths = np.diff(np.r_[starts, len(word)])
            yield table(CHUNKED, [(name, -1, blob, squeeze(np.diff(words, prepend=np.uint64(0))), ids, parts), (name, -2, squeeze(lengths), None, None, None)])

    return payload


class Counted:
    """A chunk with its answers: counts of words and pairs in main and held-out text."""

    def __init__(self, group: pa.Table):
        rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
        lengths, own, answers = rows[0], rows[1], rows[2:]
        planes = np.frombuffer(zstandard.decompress(own["main"]), np.uint8).reshape(4, -1).T
        word = np.ascontiguousarray(planes).view(np.uint32).ravel().astype(np.int64)
        self.lengths = expand(lengths["main"]).astype(np.int64)
        starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.chunk = Chunk(word, starts, np.cumsum(expand(own["dev"]), dtype=np.uint64))
        self.ids, self.parts = own["ids"], np.array(own["parts"])
        self.main, self.dev = (np.concatenate([expand(r[k]) for r in answers]).astype(float) for k in ("main", "dev"))
        if len(self.main) != len(self.chunk.words) + len(self.chunk.pairs):
            raise RuntimeError("the rows of a task changed between two reads of the documents")

    def counts(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: counts of its context, of itself, and of both together. A text begins as often as it ends."""
        c = self.chunk
        words, pairs = of[: len(c.words)], of[len(c.words) :]
        ends = words[np.searchsorted(c.words, END)]
        return np.r_[ends, words][c.before], words[c.word], pairs[c.pair]


def context_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CLASSES - 1), 0)


def shares(weights: np.ndarray, cells: list[tuple] | DataFrame, uniform: float) -> dict[int, np.ndarray]:
    """Expected tokens (pair, word, uniform) of each class under ``weights``; class CLASSES is all of them together."""
    if isinstance(cells, DataFrame):
        each = cells.select(F.explode(F.array("class", F.lit(CLASSES))).alias("class"), "pair", "word", "n")
        of = [F.get(F.lit(weights[:, k].tolist()), F.col("class")) for k in range(3)]
        got = [of[0] * F.col("pair"), of[1] * F.col("word"), of[2] * F.lit(uniform)]
        sums = each.withColumn("all", got[0] + got[1] + got[2]).groupBy("class").agg(*[F.sum(F.col("n") * g / F.col("all")).alias(f"s{k}") for k, g in enumerate(got)])
        return {r["class"]: np.array([r.s0, r.s1, r.s2]) for r in sums.collect()}  # CLASSES rows at most
    found: dict[int, np.ndarray] = {}
    for level, pair, word, n in cells:
        for k in (int(level), CLASSES):
            got = weights[k] * (pair, word, uniform)
            found[k] = found.get(k, 0) + n * got / got.sum()
    return found


def learn(cells: list[tuple[int, float, float, float]] | DataFrame, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) of each class by EM on cells (class, pair frequency, word frequency, number of tokens).

    A round is one sum over all cells, in Spark where they are a DataFrame.  A class without tokens takes the weights of
    all classes together; an unseen context has no use for pairs.
    """
    weights, met = np.full((CLASSES + 1, 3), 1 / 3), np.zeros(CLASSES + 1, bool)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(ROUNDS):
        moved = 0.0
        for k, got in shares(weights, cells, uniform).items():
            met[k], moved = True, max(moved, np.abs(got / got.sum() - weights[k]).max())
            weights[k] = got / got.sum()
        if moved < SETTLED:
            break
    weights, spare = weights[:CLASSES], weights[CLASSES]
    weights[~met[:CLASSES]] = spare
    weights[0] = (0, *(weights[0, 1:] / weights[0, 1:].sum()))
    low = weights[:, 2] < 1e-6  # an unseen word keeps some probability everywhere
    weights[low] = (weights[low] * (1 - 1e-6)) + np.array([0, 0, 1e-6])
    return weights


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Null and empty texts are scored as the end mark alone.  Repeated rows and ids are scored each, and counted each.
    A row without id is scored, but nothing is learned from it.  An empty table gives no rows.  A document is never cut:
    a very long one is a chunk of its own.  Other columns aren't read, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), remainder(F.col("doc_id"), 7).cast("int").alias("part"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    answers = rows.mapInArrow(_ask(buckets), ddl(REQUEST)).groupBy("bucket").applyInArrow(_answer(buckets), ddl(ANSWER))
    answers = cut(answers.coalesce(2 * buckets))  # no more files than groups, words and pairs of each bucket
    known = answers.where("chunk is null").agg(F.sum("distinct"), F.sum("total"), F.sum("total_main")).first()
    distinct, total, total_main = (x or 0 for x in known)
    uniform = 1 / (distinct + 1)
    none = [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("parts")]
    answered = answers.where("chunk is not null").select("chunk", "bucket", "main", "dev", *none)

    def tally(group: pa.Table) -> pa.Table:
        x = Counted(group)
        cells, n = np.unique(np.column_stack(x.counts(x.main)).astype(np.int64), axis=0, return_counts=True)
        return pa.table({"before": cells[:, 0], "word": cells[:, 1], "pair": cells[:, 2], "n": n})

    dev = rows.mapInArrow(_payload(True), ddl(CHUNKED)).unionByName(answered.where("chunk like '%-dev-%'"))
    tallied = dev.groupBy("chunk").applyInArrow(tally, "before long, word long, pair long, n long")
    level = F.when(F.col("before") > 0, F.least(F.floor(F.log2("before")).cast("int") + 1, F.lit(CLASSES - 1))).otherwise(0)
    exact = tallied.groupBy("before", "pair", "word").agg(F.sum("n").alias("n"))
    cells = exact.select(level.alias("class"), (F.col("pair") / F.greatest("before", F.lit(1))).alias("pair"), (F.col("word") / F.lit(max(total_main, 1))).alias("word"), "n")
    weights = learn(cut(cells.coalesce(max(1, -(-size // CELL_BYTES)))), uniform)

    def scored(group: pa.Table) -> pa.Table:
        x = Counted(group)
        before, word, pair = x.counts(x.main + x.dev)
        w = weights[context_class(before)]
        p = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * uniform
        base = np.log10((word + 1) / (total + 1 * (distinct + 1)))
        sums = [np.add.reduceat(v, x.chunk.starts) for v in (word > 0, base, np.log10(p))]
        held = x.parts == HELD_OUT
        return pa.table([pa.array(v, t) for v, (_, t) in zip((x.ids, held, x.lengths, sums[0].astype(np.int64), sums[1], sums[2]), SCORED, strict=True)], names=[n for n, _ in SCORED])

    everything = rows.mapInArrow(_payload(False), ddl(CHUNKED)).unionByName(answered)
    out = everything.groupBy("chunk").applyInArrow(scored, ddl(SCORED))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
