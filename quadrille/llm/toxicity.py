"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause as symbols (insult, threat, target, negation, speech, quote, other) and are
composed into one machine: a negation marks what follows it, reported speech marks all that follows, and a target marks
insults and threats as directed at someone.  What comes out are matched patterns such as "directed insult" or "negated
threat", each with the weight of its word; a clause in which nothing ends in a pattern counts for nothing.  The score of a
document is a logistic function of its patterns' weights.  Which stems of words insult, by how much, and what each pattern
is worth is learned from labels, from a prior that stands where nothing was labelled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import remainder

#: Labelled documents that stems and weights are learned from (expected number, drawn by a hash of the id).
TAUGHT = 8000
#: Lengths of stems (beginnings of words); different words before it in toxic documents, and their share of those documents;
#: least log-likelihood ratio (30: one in some 1e7 by chance); least log odds of an insult and of a mild one;
#: a stem goes if one letter more keeps this share of its documents; the largest weight; words kept between texts.
SHORTEST, LONGEST, SUPPORT, OWN_CONTEXTS, LEAST_RATIO, STRONG, MILDEST, REDUNDANT, MOST, MEMO = 3, 10, 8, 0.2, 30.0, 3.0, 1.0, 0.9, 2.0, 400_000
#: Standard deviation of weights about their prior.
PRIOR_SPREAD = 2.0
#: From this score on a document is predicted to be toxic.
TOXIC = 0.7

# Words of the lexical transducer, in English, German, French and Spanish.
INSULTS = """idiot idiots moron morons imbecile stupid dumb fool scum loser losers trash garbage pathetic worthless disgusting clown coward liar pig vermin
idiotin trottel dummkopf abschaum versager schwachkopf widerlich dumm imbécile crétin abruti ordure minable débile idiota imbécil estúpido estúpida basura patético asqueroso""".split()
THREATS = "kill hurt destroy beat stab shoot burn murder strangle töten umbringen verprügeln vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours u he she him her they them du dich dir ihr euch sie tu toi vous te ils elles tú ti usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't won't nicht kein keine nie niemals ohne pas jamais sans aucun ne nunca sin ningún jamás".split()
SPEECH = "said says say told wrote called calls quoted claimed reported allegedly sagte sagt schrieb nannte behauptet dit écrit appelle raconte prétend dijo dice escribió llamó afirma".split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
QUOTES = re.compile(r"[\"“”„«»]")
TOKEN = re.compile(rf"{WORD.pattern}|{QUOTES.pattern}")
INSULT, MILD, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(8)
HITS = (INSULT, MILD, THREAT)
CONTEXTS = ("plain", "directed", "negated", "reported")
#: Of each pattern: worth of its presence, before anything is learned; worth of each further doubling of its weight.
PRIOR = {"plain": 3.5, "directed": 4.0, "negated": 1.0, "reported": 1.0}
BASE, MORE, LESS = -2.2, 0.5, 0.1  # LESS: what a mild insult is worth of another


class Transducer:
    """States and moves (state, symbol) -> (state, symbol out); what isn't listed stays and passes through."""

    def __init__(self, moves: dict[tuple[int, tuple], tuple[int, tuple]], start: int = 0):
        self.moves, self.start = moves, start

    def step(self, state: int, symbol: tuple) -> tuple[int, tuple]:
        return self.moves.get((state, symbol), (state, symbol))

    def then(self, after: Transducer, alphabet: list[tuple]) -> Transducer:
        """The composition: what comes out of this one goes into ``after``, as one machine over pairs of states."""
        names, moves, queue = {(self.start, after.start): 0}, {}, [(self.start, after.start)]
        for own, other in queue:
            for symbol in alphabet:
                own2, middle = self.step(own, symbol)
                other2, out = after.step(other, middle)
                if (own2, other2) not in names:
                    names[own2, other2] = len(names)
                    queue.append((own2, other2))
                moves[names[own, other], symbol] = (names[own2, other2], out)
        return Transducer(moves)


def grammar() -> Transducer:
    """The machine of a clause: reported speech, then negation, then targets; the first that marks a pattern stays."""
    plain = [(k, "plain") for k in range(OTHER + 1)]
    hits = [(k, "plain") for k in HITS]

    def marks(state: int, mark: str) -> dict:
        return {(state, h): (state, (h[0], mark)) for h in hits}

    said = {(0, (REPORT, "plain")): (1, (REPORT, "plain")), (0, (QUOTE, "plain")): (2, (QUOTE, "plain")), (1, (QUOTE, "plain")): (1, (QUOTE, "plain")), (2, (QUOTE, "plain")): (0, (QUOTE, "plain"))}
    reported = Transducer(said | marks(1, "reported") | marks(2, "reported"))
    # a negation reaches the next three words
    far = {(k, s): (k - 1, s) for k in (1, 2, 3) for s in plain if s not in hits}
    far |= {(k, h): (k - 1, (h[0], "negated")) for k in (1, 2, 3) for h in hits}
    negated = Transducer(far | {(k, (NEGATION, "plain")): (3, (NEGATION, "plain")) for k in range(4)})
    directed = Transducer({(0, (TARGET, "plain")): (1, (TARGET, "plain"))} | marks(1, "directed"))
    return reported.then(negated, plain).then(directed, plain)


MACHINE = grammar()
PATTERNS = [(kind, context) for kind in HITS for context in CONTEXTS]
PLACE = {p: k for k, p in enumerate(PATTERNS)}
SYMBOLS = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, SPEECH), (THREAT, THREATS)) for w in words}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'")) if text else []


class Lexicon(dict):
    """Words met so far -> (symbol, weight); an insult begins with a learned stem (the weightiest)."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> tuple[int, float]:
        found = SYMBOLS.get(word), 1.0
        if found[0] is None:
            weight = max((self.stems.get(word[:k], 0.0) for k in range(SHORTEST, LONGEST + 1)), default=0.0)
            found = (INSULT if weight >= 1 else MILD, weight) if weight else (QUOTE, 0.0) if QUOTES.match(word) else (OTHER, 0.0)
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


def matches(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Weight of each pattern in the text.  A threat needs a target in its clause; texts without an insult or threat match nothing."""
    found = np.zeros(len(PATTERNS))
    low = text.lower().replace("’", "'") if text else ""
    if not any(lexicon[w][0] in HITS for w in set(WORD.findall(low))):
        return found
    for clause in CLAUSE.split(low):
        tokens = TOKEN.findall(clause)
        read = [lexicon[w] for w in tokens]
        heard, state = [], MACHINE.start
        for kind, weight in read:
            state, out = MACHINE.step(state, (kind, "plain"))
            if kind in HITS:
                heard.append((out, weight))
        aimed = heard and any(kind == TARGET for kind, _ in read)  # a target after the word counts as well
        for (kind, context), weight in heard:
            context = "directed" if aimed and context == "plain" else context
            if kind != THREAT or context != "plain":
                found[PLACE[kind, context]] += weight
    return found


def features(found: np.ndarray) -> np.ndarray:
    """Presence of each pattern, and how often its weight doubles beyond one."""
    return np.concatenate([np.minimum(found, 1), np.log2(np.maximum(found, 1))], axis=-1)


class Model:
    """Weights of insulting stems, and of patterns (base first)."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray | None = None):
        self.stems, self.weights = stems, prior() if weights is None else weights

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        z = self.weights[0] + features(matches(text, lexicon)) @ self.weights[1:]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(z)))))


def prior() -> np.ndarray:
    worth = [PRIOR[c] * (LESS if kind == MILD else 1) for kind, c in PATTERNS]
    return np.array([BASE, *worth, *[MORE] * len(PATTERNS)])


def fitted(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Logistic weights of rows of features seen ``toxic`` and ``clean`` times: the likeliest under a normal prior, by Newton's steps."""
    start, a = prior(), np.column_stack([np.ones(len(x)), x])
    w, n = start.copy(), toxic + clean
    hold = np.full(len(w), 1 / PRIOR_SPREAD**2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (toxic - n * p) - hold * (w - start)
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.diag(hold), slope)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def taught(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, clean) of the documents whose labels may be learned from: crc32(doc_id) mod 3 is not 1, and drawn.

    The labels drawn are a row for each id, some ``sample`` of them (a dozen bytes each).
    """
    own = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id"), 3) != 1)
    each = own.groupBy("doc_id").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean"))
    count = each.count()
    drawn = each.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1.0, sample / max(count, 1)))))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "toxic", "clean")


def stems_of(rows: DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """Weights of the stems that tell toxic documents (``toxic`` of them) from others; listed insults have theirs from the start."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text, bad, good in zip(x.text, x.toxic, x.clean, strict=True):
                words, first = words_of(text), {}
                for before, w in zip(["", *words], words, strict=False):
                    first.setdefault(w, before)
                stems: dict[str, str] = {}
                for w, before in first.items():
                    for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                        stems.setdefault(w[:k], before)
                for stem, before in stems.items():
                    n = seen.setdefault((stem, before if bad else ""), [0, 0])
                    n[0] += bad
                    n[1] += good
            yield pd.DataFrame([(*k, *n) for k, n in seen.items()], columns=["stem", "before", "toxic", "clean"])

    pairs = rows.mapInPandas(count, "stem string, before string, toxic long, clean long").groupBy("stem", "before").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    stems = pairs.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.when(F.col("toxic") > 0, 1)).alias("contexts"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    share = toxic / max(toxic + clean, 1.0)
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (F.col("toxic") * F.log(F.greatest("toxic", F.lit(1)) / (both * F.lit(share))) + F.col("clean") * F.log(F.greatest("clean", F.lit(1)) / (both * F.lit(1 - share))))
    strong = (F.col("contexts") >= SUPPORT) & (F.col("contexts") >= OWN_CONTEXTS * F.col("toxic")) & (odds >= MILDEST) & (ratio >= LEAST_RATIO)
    listed = F.col("stem").isin(INSULTS) & (both >= SUPPORT)
    met = {r.stem: r for r in stems.select("stem", "toxic", "clean", odds.alias("odds"), strong.alias("strong")).where(strong | listed).collect()}  # few: those of the sample that stand out
    longer = {s[:-1] for s, r in met.items() if r.strong and s[:-1] in met and r.toxic >= REDUNDANT * met[s[:-1]].toxic}
    sure = {s: r.odds for s, r in met.items() if r.strong and s not in longer and s not in SYMBOLS}
    known = {w: 1.0 for w in INSULTS if w not in met or met[w].odds > 0}
    return known | {s: min(MOST, odds / STRONG) for s, odds in sure.items()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = TAUGHT) -> Model:
    """Stems and weights from a bounded sample of labelled documents whose crc32(doc_id) mod 3 isn't 1.

    Labels without an id, or other than 0 and 1, and null texts teach nothing; of an id with several labels each counts, and
    repeated documents teach each.  An empty text has no words and matches nothing.  A stem is learned if it occurs in
    toxic documents after enough different words (so that copies of one passage don't teach its words), and
    significantly more often than in others; listed insults are known from the start, but go where labels say so.  No
    labels, or no documents, leave the prior.  Other columns aren't read, whatever their names.
    """
    rows = taught(docs, labels, sample)
    toxic, clean = (float(x or 0) for x in rows.agg(F.sum("toxic"), F.sum("clean")).first())
    if not toxic or not clean:
        return Model({w: 1.0 for w in INSULTS})
    stems = stems_of(rows, toxic, clean)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(stems)
        for x in batches:
            found = [tuple(matches(t, lexicon).tolist()) for t in x.text]
            yield pd.DataFrame({"found": found, "toxic": x.toxic, "clean": x.clean}).groupby("found", as_index=False).sum().assign(found=lambda g: [list(f) for f in g.found])

    table = rows.mapInPandas(match, "found array<double>, toxic long, clean long").groupBy("found").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()  # of the sample
    return Model(stems, fitted(features(np.stack(table.found.to_list())), table.toxic.to_numpy(float), table.clean.to_numpy(float)))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the column ``to``: how likely the whole text is toxic, 0 to 1.

    Null and empty texts, and texts without a match, get the base score.  A column named as ``to`` is replaced; repeated rows
    and rows without an id are scored like others; an empty table gives no rows.
    """
    held: list[Lexicon] = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Lexicon(model.stems))
        return pd.Series([model.score(t, held[0]) for t in texts], dtype=float)

    return docs.withColumn(to, of(F.col(text)))
