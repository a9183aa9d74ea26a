"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause's words in turn, each what the one before it has written: negation marks
the words in its reach, reported speech marks its clause, targets mark the words that follow them,
insults pair with a target before or after them, and threats with a target after them. Each is a small
table of states; composed, they are one automaton over a common alphabet, whose transitions carry
weights. What is scored are the clauses in which a pattern matches (target and insult, threat and
target); insults that find no target are a feature of their own. A logistic model of these features
gives the probability that the document is toxic.

Insults are learned from labelled rows: words and stems (prefixes) whose share among toxic documents
is far above that among others, in surroundings of many kinds, so that copies of one toxic text don't
lend their neutral words weight. The weights come from one half of the sample and the logistic model
from the other. At most ``max_rows`` labelled rows and ``max_atoms`` words and stems are used.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import private_names, shared_dir, stored, without

TARGETS = frozenset("you your yours yourself he him his she her they them their du dich dir dein deine ihr euch euer sie tu te toi ton ta vous votre vos il elle ils elles tú ti tus usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote called claimed reported quoted according sagte sagt schrieb nannte laut zufolge dit disait écrit appelé selon dijo dice escribió llamó según".split())
THREAT_ENDINGS = {"kill hurt destroy beat shoot stab burn murder": ["", "s", "ed", "ing"], "töt umbring schlag verletz": ["e", "en", "t", "st", "te"], "tu frapp détrui bless": ["er", "e", "é", "re", "erai"], "mat golpe destru": ["ar", "aré", "ir", "iré"]}
THREATS = frozenset(stem + end for stems, ends in THREAT_ENDINGS.items() for stem in stems.split() for end in ends)
#: Words that a negation, a target before an insult, a target after it, and a threat reach.
NEG_REACH, TARGET_REACH, INSULT_REACH, THREAT_REACH = 3, 5, 5, 4
#: What negation and reported speech make of a weight, the weight of a threat, and the insults' weights by level.
NEGATED, REPORTED, THREAT_WEIGHT = 0.4, 0.6, 3.0
LEVELS, LEVEL_FROM = (2.0, 4.0, 6.0), (3.0, 5.0)
STEMS = range(4, 9)
FEATURES = ["matched", "peak", "bare", "rate"]
CACHED = 300_000

#: The alphabet, and the marks that transducers write beside a symbol.
OTHER, END, TARGET, NEGATION, REPORT, THREAT, *INSULTS = range(6 + len(LEVELS))
ALPHABET = (OTHER, END, TARGET, NEGATION, REPORT, THREAT, *INSULTS)
NEG, NEAR, SPEECH = 1, 2, 4
#: A transducer: from a state, a symbol and its marks to the next state, the marks written, and weights (matched, bare).
Step = Callable[[object, int, int], tuple[object, int, float, float]]

_tokens = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]").findall


def reaching(symbol: int, reach: int, mark: int) -> Step:
    """Marks the words that follow a symbol within its reach. The state: for how many more words it does."""

    def step(left: int, read: int, marks: int) -> tuple[int, int, float, float]:
        if read == END:
            return 0, marks, 0.0, 0.0
        return reach if read == symbol else max(0, left - 1), marks | mark if left else marks, 0.0, 0.0

    return step


def speech(reported: int, read: int, marks: int) -> tuple[int, int, float, float]:
    """Marks the end of a clause that has a word of reporting."""
    if read == END:
        return 0, marks | SPEECH if reported else marks, 0.0, 0.0
    return int(reported or read == REPORT), marks, 0.0, 0.0


def insults(waiting: tuple[float, int] | int, read: int, marks: int) -> tuple[tuple[float, int] | int, int, float, float]:
    """Insults with a target near match; others wait for a target and are bare if none comes in time or
    another insult comes first. The state: the weight that waits, and for how many more words."""
    weight, left = waiting or (0.0, 0)
    if read in INSULTS:
        w = LEVELS[read - INSULTS[0]] * (NEGATED if marks & NEG else 1.0)
        return (0, marks, w, weight) if marks & NEAR else ((w, INSULT_REACH), marks, 0.0, weight)
    if read == TARGET and weight:
        return 0, marks, weight, 0.0
    if weight and (read == END or left == 1):
        return 0, marks, 0.0, weight
    return ((weight, left - 1) if weight else 0), marks, 0.0, 0.0


def threats(left: int, read: int, marks: int) -> tuple[int, int, float, float]:
    """A threat that isn't negated matches when a target follows it. The state: for how many more words."""
    if read == THREAT and not marks & NEG:
        return THREAT_REACH, marks, 0.0, 0.0
    if read == TARGET and left:
        return 0, marks, THREAT_WEIGHT, 0.0
    return (0 if read == END else max(0, left - 1)), marks, 0.0, 0.0


GRAMMAR: list[Step] = [reaching(NEGATION, NEG_REACH, NEG), speech, reaching(TARGET, TARGET_REACH, NEAR), insults, threats]


def composed(parts: list[Step]) -> tuple[list[int], list[tuple[float, float, bool] | None]]:
    """One automaton of the transducers, each reading what the one before writes: for each state (times
    the alphabet's size) and symbol, the next state (times the same) and the weights, None for none. The
    third of the weights says that the clause that ends here is reported."""
    start = (0,) * len(parts)
    number, found, after, weights = {start: 0}, [start], [], []
    for state in found:  # grows as states are reached
        for symbol in ALPHABET:
            marks, matched, bare, new = 0, 0.0, 0.0, []
            for step, own in zip(parts, state, strict=True):
                own, marks, m, b = step(own, symbol, marks)
                new.append(own)
                matched, bare = matched + m, bare + b
            if (key := tuple(new)) not in number:
                number[key] = len(found)
                found.append(key)
            after.append(number[key] * len(ALPHABET))
            weights.append((matched, bare, bool(marks & SPEECH)) if matched or bare or marks & SPEECH else None)
    return after, weights


@functools.cache
def automaton() -> tuple[list[int], list[tuple[float, float, bool] | None]]:
    return composed(GRAMMAR)


def clause_weights(symbols: list[int]) -> Iterator[tuple[float, float]]:
    """(matched, bare) of each clause that has any; the text's end ends its last clause."""
    after, weights = automaton()
    state, matched, bare = 0, 0.0, 0.0
    for symbol in [*symbols, END]:
        w = weights[state + symbol]
        state = after[state + symbol]
        if w is not None:
            matched, bare = matched + w[0], bare + w[1]
        if symbol == END:
            if matched or bare:
                share = REPORTED if w is not None and w[2] else 1.0
                yield matched * share, bare * share
            matched, bare = 0.0, 0.0


def atoms(word: str) -> list[str]:
    """A word and its stems; a stem ends in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class Grammar:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def insult(self, word: str) -> float:
        return max((self.weights.get(a, 0.0) for a in atoms(word)), default=0.0)

    def symbol(self, token: str) -> int:
        """What a token is in the automaton's alphabet."""
        if token in ".!?;:\n":
            return END
        if (w := self.insult(token)) > 0:
            return INSULTS[sum(w >= x for x in LEVEL_FROM)]
        return next((s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) if token in words), OTHER)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Logs of the matched weight of all clauses, of the largest one's, of the bare weight, and of all
        weight for a hundred words."""
        tokens = _tokens(text.lower()) if text else []
        if len(self.known) > CACHED:
            self.known.clear()
        for t in set(tokens).difference(self.known):
            self.known[t] = self.symbol(t)
        symbols = list(map(self.known.__getitem__, tokens))
        if not tokens or max(symbols) < THREAT:
            return 0.0, 0.0, 0.0, 0.0
        found = [(0.0, 0.0), *clause_weights(symbols)]
        matched, bare = sum(m for m, _ in found), sum(b for _, b in found)
        return math.log1p(matched), math.log1p(max(m for m, _ in found)), math.log1p(bare), math.log1p(100 * (matched + bare) / len(tokens))


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic, half) of about max_rows labelled rows outside the held-out fold, by hash of the key."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_toxic"))
    rate = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(rate * (1 << 20))).limit(2 * max_rows)
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(known), key)  # two numbers a row, 2 * max_rows at most
    return rows.select("_text", "_toxic", (F.pmod(F.xxhash64(F.lit(3), key), F.lit(2)) == 0).alias("_half")).where("_text is not null")


def learn_atoms(rows: DataFrame, max_atoms: int, min_docs: int = 5, min_odds: float = 2.0) -> dict[str, float]:
    """Weights of insults: log odds of words and stems, from labelled rows."""

    def positive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch["_text"]:
                tokens, seen = _tokens(text.lower()), set()
                for before, word in zip(["", *tokens], tokens, strict=False):
                    bit = 1 << (hash_of(before) % 60)
                    for a in atoms(word):
                        c = counts.setdefault(a, [0, 0])
                        c[1] |= bit
                        if a not in seen:
                            seen.add(a)
                            c[0] += 1
        if counts:
            yield pd.DataFrame({"atom": list(counts), "p": [c[0] for c in counts.values()], "mask": [c[1] for c in counts.values()]})

    found = rows.where("_toxic = 1").select("_text").mapInPandas(positive, "atom string, p long, mask long").groupBy("atom").agg(F.sum("p").alias("p"), F.bit_or("mask").alias("mask"))
    found = found.where((F.col("p") >= min_docs) & (F.bit_count("mask") >= min_docs)).orderBy(F.desc("p"), "atom").limit(4 * max_atoms).select("atom", "p")
    counts = {r.atom: r.p for r in found.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(counts))

    def negative(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, int] = {}
        for batch in batches:
            for text in batch["_text"]:
                for a in {a for w in set(_tokens(text.lower())) for a in atoms(w)} & shared.value:
                    own[a] = own.get(a, 0) + 1
        if own:
            yield pd.DataFrame({"atom": list(own), "n": list(own.values())})

    others = rows.where("_toxic = 0").select("_text").mapInPandas(negative, "atom string, n long").groupBy("atom").agg(F.sum("n").alias("n"))
    against = {r.atom: r.n for r in others.collect()}  # one row for each of at most 4 * max_atoms
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    p_all, n_all = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    odds = {a: math.log((p + 0.5) / p_all) - math.log((against.get(a, 0) + 0.5) / n_all) for a, p in counts.items()}
    best = sorted((a for a, o in odds.items() if o >= min_odds), key=lambda a: (-odds[a] * math.log(counts[a]), a))[:max_atoms]
    return {a: odds[a] for a in best}


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def _features(grammar: Grammar):
    @F.pandas_udf(", ".join(f"{n} double" for n in FEATURES))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([grammar.features(t) for t in batch], columns=FEATURES)

    return features


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method on a bounded sample; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_atoms: int = 5_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """The insults' weights and the coefficients (FEATURES, then the constant)."""
    rows = stored(sample(docs, labels, max_rows, key, text, label), f"{shared_dir(docs.sparkSession)}/labelled")
    weights = learn_atoms(rows.where("_half"), max_atoms)
    pairs = rows.where("not _half").select(_features(Grammar(weights))("_text").alias("f"), "_toxic").select("f.*", "_toxic").toPandas()  # at most 2 * max_rows rows of numbers
    if not len(pairs):
        return weights, [0.0] * len(FEATURES) + [-4.0]
    return weights, fit_logistic(pairs[FEATURES].to_numpy(), pairs["_toxic"].to_numpy()).tolist()


@private_names
def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out (crc32 of the key as text, mod 5, is 0), score (0 to 1) and predicted (1 from
    0.5 on). Null and empty texts have no clauses and get the score of such; a null key counts as the
    empty text for the fold. Columns of these names are replaced; every row is scored, of any length."""
    weights, b = model
    docs = without(docs, "held_out", "score", "predicted")
    rows = docs.select("*", _features(Grammar(weights))(text).alias("_f"))
    z = sum((F.lit(c) * F.col(f"_f.{n}") for n, c in zip(FEATURES, b, strict=False)), F.lit(b[-1]))
    rows = rows.select(*docs.columns, held_out(key).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
