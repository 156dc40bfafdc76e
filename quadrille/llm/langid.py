"""Language ID by word-first backoff.

A known word scores its log frequency in each language; an unseen word falls back to the longest character n-grams of
it that are known, five characters first, then progressively shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each language that the tables are fitted on (expected number, drawn by a hash of the id);
#: longest n-gram; scored words kept between documents.
SAMPLE, LONGEST, MEMO = 3000, 5, 400_000
#: Words after which more text doesn't make a prediction surer.
EVIDENCE = 20
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lowered; none where the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Model:
    """Log-frequency tables of words and n-grams, and a row of ``scores`` for each unseen word met so far."""

    def __init__(self, counts: pa.Table):
        langs, grams = (counts.column(c).combine_chunks().dictionary_encode() for c in ("lang", "gram"))
        self.langs = sorted(langs.dictionary.to_pylist())
        place = np.array([self.langs.index(x) for x in langs.dictionary.to_pylist()], np.int64)
        lang, gram = place[langs.indices.to_numpy()], grams.indices.to_numpy()
        kind, n = counts.column("kind").to_numpy(), counts.column("n").to_numpy()
        self.tables = {}
        for k in np.unique(kind).tolist():  # 0: words; n: n-grams
            own = kind == k
            known, row = np.unique(gram[own], return_inverse=True)
            seen = np.zeros((len(known), len(self.langs)))
            seen[row, lang[own]] = n[own]
            names = grams.dictionary.take(pa.array(known)).to_pylist()
            self.tables[k] = (dict(zip(names, range(len(names)), strict=True)), np.log((seen + 0.5) / (seen.sum(0) + 0.5 * len(seen))))
        self.reset()

    def reset(self) -> None:
        """Forget the unseen words met so far; known words are looked up where they are."""
        self.known, self.logs = self.tables.get(0, ({}, np.zeros((0, len(self.langs)))))
        self.met, self.scores = {}, np.zeros((1024, len(self.langs)))

    def backoff(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known, logs = self.tables.get(n, ({}, None))
            if rows := [known[g] for g in grams_of(word, n) if g in known]:
                return logs[rows].mean(0)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        """Of an unseen word, in ``scores``."""
        if (k := self.met.get(word)) is None:
            k = self.met[word] = len(self.met)
            if k >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[k] = self.backoff(word)
        return k

    def total(self, words: list[str]) -> np.ndarray:
        rows = [self.known.get(w) for w in words]
        unseen = [self.row(w) for w, k in zip(words, rows, strict=True) if k is None]
        seen = [k for k in rows if k is not None]
        return (self.logs[seen].sum(0) if seen else 0) + (self.scores[unseen].sum(0) if unseen else 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` and 0 for a text without letters, or where nothing was learned."""
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        if len(self.met) > MEMO:
            self.reset()
        total = self.total(words) * min(1.0, EVIDENCE / len(words))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Tables from a bounded sample of rows with text and lang whose crc32(doc_id) mod 4 isn't 2.

    Rows without an id, a text or a lang teach nothing; repeated rows and ids teach each, an empty text no words, a very long
    one all its words.  An empty table, or one without labels, gives a model without languages.  Other columns aren't read,
    whatever their names.
    """
    taught = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder(F.col("doc_id"), 4) != 2)
    sizes = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row for each language
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample / n)]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    dice = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = taught.select("lang", "text", dice.alias("dice"), F.element_at(share, F.col("lang")).alias("share")).where("dice < share").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: dict[tuple, Counter] = {}
            for lang, text in zip(x.lang, x.text, strict=True):
                words = Counter(words_of(text))
                seen.setdefault((lang, 0), Counter()).update(words)
                for n in range(1, LONGEST + 1):
                    grams = seen.setdefault((lang, n), Counter())
                    for w, times in words.items():
                        for g in grams_of(w, n):
                            grams[g] += times
            yield pd.DataFrame([(lang, kind, g, n) for (lang, kind), c in seen.items() for g, n in c.items()], columns=["lang", "kind", "gram", "n"])

    counts = drawn.mapInPandas(count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow())  # every word and n-gram of the sample


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """docs with the struct column ``to``: lang_pred and score; whole texts, one row for each row of docs.

    Null and empty texts, those without a letter, and all texts under a model without languages are ``und`` with score 0.
    Of languages that are equally likely the first by name is taken.  A column of docs named as ``to`` is replaced; repeated
    rows and rows without an id are predicted like others; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))  # bounded by SAMPLE
    held: list[Model] = []

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not held:
            own = Model.__new__(Model)
            own.langs, own.tables = shared.value
            own.reset()
            held.append(own)
        return pd.DataFrame([held[0].predict(x) for x in texts], columns=["lang_pred", "score"])

    return docs.withColumn(to, of(F.col(text)))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose language can be told with a probability of ``least``, with all their columns.

    Texts that are null or have no letter go; so does everything where nothing was labelled.  Repeated rows stay or go
    together.  Learning and ties as in fit() and predict().
    """
    own = "__language"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    return predict(docs, fit(docs), to=own).where(f"{own}.lang_pred <> '{UNDETERMINED}' and {own}.score >= {least}").drop(own)
