"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole.  Its tokens' spans and its sections are two sorted lists of intervals over the
same text; one merge of the two gives each section its tokens.  A token across a boundary goes by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the published vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: To the section of its first byte, of its last byte, or to each section the share of its bytes that lie there.
RULES = ("start", "end", "split")


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """From the lines ``base64 rank`` of a vocabulary file."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(coder: tiktoken.Encoding) -> np.ndarray:
    lengths = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        lengths[coder.encode_single_token(token)] = len(token)
    return lengths


def line_starts(data: np.ndarray) -> np.ndarray:
    """Sections are lines with their line feed; a text that ends in one has no further section."""
    starts = np.r_[0, np.flatnonzero(data == 10) + 1]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


def attribute(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section: tokens by the rule, and how many of the tokens that begin there end beyond it.

    ends: of the tokens, which tile the text; starts: of the sections, which tile it too; all in bytes.
    """
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.bincount(first[first != last], minlength=len(starts))
    if rule == "split":
        done = np.interp(np.r_[starts, total], np.r_[0, ends], np.arange(len(ends) + 1))  # tokens up to each boundary
        return np.diff(done), crossing
    return np.bincount(first if rule == "start" else last, minlength=len(starts)).astype(float), crossing


def section_tokens(docs: DataFrame, vocabulary: str, text: str = "text", rule: str = "start") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) of each line of each row; start and end count characters.

    n_tokens is a double: whole for the rules start and end, shares for split; over a document it sums to the number of
    tokens.  Null and empty texts have one empty section.  Ids may be null or repeated; repeated rows are each counted.
    A very long text is encoded whole in one task.  A token's only tie, bytes in two sections, is settled by the rule.  Other
    columns aren't read, whatever their names; an empty table gives no rows.
    The vocabulary file is read on the driver, and sent out (about 1 MB).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(shared.value)
        lengths = token_lengths(coder)

        def flush(ids, row, parts):
            section, start, end, tokens, crossing = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *map(pa.array, (section, start, end, tokens, crossing))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

        for batch in batches:
            ids, row, parts, held = batch.column(0), [], [], 0
            for k, x in enumerate(batch.column(1)):
                value = x.as_py() or ""
                ends = np.cumsum(lengths[np.array(coder.encode_ordinary(value), np.int64)])
                data = np.frombuffer(value.encode(), np.uint8)
                starts = line_starts(data)
                tokens, crossing = attribute(ends, starts, len(data), rule)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters up to each byte
                parts.append((np.arange(len(starts)), chars[starts], chars[np.r_[starts[1:], len(data)]], tokens, crossing))
                row += [k] * len(starts)
                held += len(starts)
                if held > 100_000:
                    yield flush(ids, row, parts)
                    row, parts, held = [], [], 0
            if parts:
                yield flush(ids, row, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(count, f"doc_id {kind}, section long, start long, end long, n_tokens double, n_crossing long")
