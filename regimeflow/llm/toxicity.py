"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause: *insult* and *threat* mark a word of their lexicon with its weight,
*target* remembers that somebody was addressed, *negation* reaches over the next words, *reported speech* over the rest
of the clause.  Composed, they form one deterministic transducer (``GRAMMAR``): a marked word is emitted on the channel
that the other transducers' states select, a clause end resets them.  A document's features are the weights emitted
per channel; a logistic model turns them into a score.

The lexicon is learned from labels: words and word beginnings that documents labelled toxic hold and others do not,
counted over different texts only (a sketch of each text tells copies apart), at most ``MAX_TERMS`` terms.  Lexicon
and model are fitted on at most about ``TRAIN_DOCS`` labelled documents drawn by hash (a stated bound).  Scoring is one
narrow pass over whole texts: an Aho-Corasick automaton finds marked words, and only clauses around them are read.

Only the text is an input of a score.  Edge cases: a null or empty text gets the score of a text without matches;
rows without a label, or with a null one, take no part in training; a doc_id with several labels counts as often;
without any toxic label every score is 0.  Repeated rows are scored alike, an empty table gives no rows, and the other
columns of the table pass through unchanged where ``filter_toxic`` returns them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeflow.llm.common import text_or_empty

TRAIN_DOCS, MAX_TERMS, MIN_TEXTS, MIN_PURITY = 20_000, 2_000, 4, 0.9
PREFIXES = range(4, 10)
FOLDS = 5

# Seed words of the closed classes, in the languages of the corpus.
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "attack", "töten", "schlagen", "vernichten", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "they", "them", "he", "she", "people", "du", "dich", "sie", "ihr", "tu", "toi", "vous", "ils", "tú", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "cannot", "without", "nicht", "kein", "keine", "keinen", "nie", "niemals", "ohne", "pas", "jamais", "sans",
             "nunca", "ni", "tampoco", "sin")  # and every contraction in n't
REPORTS = ("said", "says", "called", "quoted", "claimed", "wrote", "sagte", "nannte", "dit", "appelé", "dijo", "llamó")
REACH = 3  # words that a negation covers

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
CLOSED = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT)}
CHANNELS = [(what, how) for what in ("insult", "threat") for how in ("plain", "targeted", "negated", "reported")]
_TOKEN = re.compile(r"\w+n['\u2019]t\b|\w+|[.!?;:\n|]")
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[.!?;:\n|]")
_CONTRACTED = ("n't", "n\u2019t")


def lowered(text: str) -> str:
    """Lower case, a code point for a code point, so that offsets are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Transducer:
    """Deterministic: (state, symbol) -> next state; ``holds[state]`` says whether it applies to the next marked word."""

    def __init__(self, n_states: int, moves: dict[tuple[int, int], int], holds: set[int]):
        self.n_states, self.moves, self.holds = n_states, moves, holds

    def next(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), state)


def flag(symbol: int) -> Transducer:
    """On from a symbol to the end of the clause."""
    return Transducer(2, {(0, symbol): 1, (1, STOP): 0}, {1})


def reach(symbol: int, words: int) -> Transducer:
    """On for some words after a symbol."""
    moves = {(s, symbol): words for s in range(words + 1)}
    moves |= {(s, x): s - 1 for s in range(1, words + 1) for x in (WORD, INSULT, THREAT, TARGET, REPORT)}
    moves |= {(s, STOP): 0 for s in range(words + 1)}
    return Transducer(words + 1, moves, set(range(1, words + 1)))


def compose(target: Transducer, negation: Transducer, report: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """The product: next state and emitted channel (-1: none) per state and symbol."""
    states = list(product(range(target.n_states), range(negation.n_states), range(report.n_states)))
    index = {s: i for i, s in enumerate(states)}
    go, emit = [], []
    for t, n, r in states:
        go.append([index[target.next(t, x), negation.next(n, x), report.next(r, x)] for x in range(7)])
        how = 3 if r in report.holds else 2 if n in negation.holds else 1 if t in target.holds else 0
        emit.append([-1, how, 4 + how, -1, -1, -1, -1])
    return go, emit


GRAMMAR = compose(flag(TARGET), reach(NEGATION, REACH), flag(REPORT))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


# ------------------------------------------------------------------------------------------------------- training

def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic of labelled rows that are not held out, about ``train_docs`` at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = int(min(1.0, train_docs / max(known.count(), 1)) * (1 << 20))
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 20)) <= share
    known = known.where(~held_out(F.col("doc_id")) & drawn)
    return docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id").select("text", "toxic")


def learn_terms(rows: DataFrame) -> dict[str, tuple[float, bool]]:
    """Term -> (weight, whether it is a word beginning)."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sketches, held = [], []
            for text in frame["text"]:
                words = _WORD.findall(lowered(text))
                threes = (" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1)))
                sketches.append(min(xxhash.xxh64_intdigest(t) for t in threes) - (1 << 63))
                once = set(words)
                held.append(list(once | {w[:n] + "*" for w in once for n in PREFIXES if len(w) > n}))
            yield pd.DataFrame({"toxic": frame["toxic"], "sketch": sketches, "terms": held})

    held = rows.select("toxic", "text").mapInPandas(read, "toxic int, sketch long, terms array<string>")
    terms = held.select("toxic", "sketch", F.explode("terms").alias("term")).distinct()
    count = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    pure = count.where((F.col("bad") >= MIN_TEXTS) & (F.col("bad") >= MIN_PURITY * F.col("n")))
    found = pure.orderBy(F.desc("bad"), "term").limit(MAX_TERMS).collect()
    out: dict[str, tuple[float, bool]] = {}
    for term, bad, n in found:
        text, begins = term.removesuffix("*"), term.endswith("*")
        if text not in out or begins:
            out[text] = (float(np.log((bad + 0.5) / (n - bad + 0.5))), begins)
    return out


class Grammar:
    """The lexicon transducers and the composed grammar; small, sent to the tasks as it is."""

    def __init__(self, terms: dict[str, tuple[float, bool]], weights: np.ndarray | None = None):
        self.terms = terms
        # a threat stays one when labels mark it, and takes the weight that they give it
        threats = {t: (THREAT, terms[t][0] if t in terms else 1.0, True) for t in THREATS}
        self.lexicon = {**{t: (INSULT, w, p) for t, (w, p) in terms.items()}, **threats}
        self.longest = max(map(len, self.lexicon))
        self.weights = weights
        self._find = None

    def __getstate__(self):
        return {**self.__dict__, "_find": None}

    def features(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """Weight emitted per channel, and the matched clauses as (start, end, weight)."""
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for t in self.lexicon:
                self._find.add_word(t, len(t))
            self._find.make_automaton()
        sums, clauses = np.zeros(len(CHANNELS)), []
        low = lowered(text)
        stops, done = None, -1
        for end, size in self._find.iter(low):
            start = end - size + 1
            if start < done or (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
                continue
            if stops is None:  # clause ends, found once
                stops = [-1, *(m.start() for m in _STOP.finditer(low)), len(low)]
            at = bisect_left(stops, start)
            begin, stop = stops[at - 1] + 1, stops[at]
            weight = self._clause(low[begin:stop], sums)
            if weight:
                clauses.append((begin, stop, weight))
            done = stop
        return sums, clauses

    def _clause(self, clause: str, sums: np.ndarray) -> float:
        go, emit = GRAMMAR
        state, total = 0, 0.0
        for token in _TOKEN.findall(clause):
            symbol, weight = self._symbol(token)
            channel = emit[state][symbol]
            if channel >= 0:
                sums[channel] += weight
                total += weight
            state = go[state][symbol]
        return total

    def _symbol(self, token: str) -> tuple[int, float]:
        best = None
        for n in range(min(len(token), self.longest), 0, -1):
            entry = self.lexicon.get(token[:n])
            if entry and (entry[2] or n == len(token)):
                best = entry
                break
        if best:
            return best[0], best[1]
        if token.endswith(_CONTRACTED):
            return NEGATION, 0.0
        return (STOP if _STOP.match(token) else CLOSED.get(token, WORD)), 0.0

    def score(self, sums: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights @ _design(sums[None, :])[0], -30, 30))))


def _design(sums: np.ndarray) -> np.ndarray:
    """Constant, all insults together, then each channel: what the channels share is learned once."""
    return np.concatenate([np.ones((len(sums), 1)), np.log1p(sums[:, :4].sum(axis=1, keepdims=True)), np.log1p(sums)], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: np.ndarray, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w += np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Grammar:
    rows = training_rows(docs, labels, train_docs)
    grammar = Grammar(learn_terms(rows))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "sums": [np.round(grammar.features(t)[0], 3).tolist() for t in frame["text"]]})

    seen = rows.select("toxic", "text").mapInPandas(emit, "toxic int, sums array<double>")
    rows_ = seen.groupBy("toxic", "sums").count().collect()  # at most a row per training document
    if rows_ and any(r["toxic"] for r in rows_):
        x = _design(np.array([r["sums"] for r in rows_]))
        y, n = np.array([float(r["toxic"] > 0) for r in rows_]), np.array([float(r["count"]) for r in rows_])
        grammar.weights = _fit_logistic(x, y, n, np.array([0.1, 0.1] + [3.0] * len(CHANNELS)))
    return grammar


# -------------------------------------------------------------------------------------------------------- scoring

def score_texts(docs: DataFrame, grammar: Grammar, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score``, ``clauses`` (start, end, weight; code points) of every row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [grammar.features(t) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "score": [grammar.score(s) for s, _ in found],
                                "clauses": [[{"start": a, "end": b, "weight": w} for a, b, w in c] for _, c in found]})

    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.struct(F.col(key).alias("key")).alias("key"), text_or_empty(text).alias("text"))
    out = keyed.mapInPandas(run, f"key struct<key:{kind}>, score double, clauses array<struct<start:int,end:int,weight:double>>")
    return out.select(F.col("key.key").alias(key), "score", "clauses")


def filter_toxic(docs: DataFrame, grammar: Grammar, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``limit``, unchanged."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"]
            yield frame[[grammar.score(grammar.features(t or "")[0]) < limit for t in texts]]

    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(inner, text_or_empty(text).alias("text")).mapInPandas(run, f"row {docs.schema.simpleString()}, text string")
    return kept.select("row.*")
