"""Secret scans: fixed patterns, and character Markov models for what the patterns miss.

Two first-order Markov models over the characters of tokens are trained from labelled samples: *random* from the
values that the base patterns find, *ordinary* from identifiers and words outside of them (long ones with a digit or a run of
``MIN_LENGTH`` letters are left out: they may be either).  A token of at least
``MIN_LENGTH`` characters outside the base spans becomes a span of kind ``markov`` when the log-likelihood ratio of
the two models is at least ``MIN_RATIO`` nats in all and ``MIN_MEAN`` per character; it must hold a letter,
so that card and telephone numbers are left to other scans.

Training reads a sample of at most about ``SAMPLE_DOCS`` documents, drawn by hash (a stated bound); its counts are
added up in the tasks and by Spark, and the driver sees one row per model and pair of characters.  The scan is one
narrow pass over every whole text.

Edge cases: a null text counts as empty, an empty text has no spans.  Spans are in code points, end exclusive, whole
matches; overlapping spans of different base kinds all stay.  Without any sample both models are uniform and nothing is
added.  Repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeflow.llm.common import text_or_empty

SAMPLE_DOCS, MIN_LENGTH, MIN_RATIO, MIN_MEAN, BACK_OFF = 20_000, 16, 12.0, 0.5, 20.0
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs of 24 and more: the leftmost match of a run is the whole run
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{5,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
N = len(ALPHABET) + 1  # and the start of a token
_CODE = np.full(128, N - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(N - 1)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _outside(matches: Iterator[re.Match], taken: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Matches that overlap no taken span: of the spans that begin before a match ends, none may end inside or after it."""
    spans = sorted((a, b) for _, a, b in taken)
    begins, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    for m in matches:
        before = bisect_left(begins, m.end())
        if not before or reach[before - 1] <= m.start():
            yield m


def _steps(token: str) -> np.ndarray:
    """Index of every transition of a token in a flattened matrix, the start included."""
    code = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return np.concatenate(([N - 1], code[:-1])) * N + code


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The matrix of log-likelihood ratios, random against ordinary, per transition."""
    n = docs.count()
    share = int(min(1.0, sample_docs / max(n, 1)) * (1 << 20))
    some = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), F.col(key).cast("string")), F.lit(1 << 20)) < share + 1).select(text_or_empty(text).alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, N * N), np.int64)
        for frame in frames:
            for t in frame["text"]:
                spans = base_spans(t)
                values = [m[2] for m in ASSIGN.finditer(t) if len(m[2]) >= MIN_LENGTH]
                values += [t[a:b] for kind, a, b in spans if kind != "assign"]
                words = [m[0] for m in _outside(ORDINARY.finditer(t), spans) if not _doubtful(m[0])]
                for label, tokens in ((1, values), (0, words)):
                    if tokens:
                        total[label] += np.bincount(np.concatenate([_steps(w) for w in tokens]), minlength=N * N)
        label, step = np.nonzero(total)
        yield pd.DataFrame({"label": label, "step": step, "n": total[label, step]})

    counts = np.zeros((2, N, N))
    for label, step, k in some.mapInPandas(count, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n")).collect():
        counts[label, step // N, step % N] = k
    if not counts[1].sum():
        return np.zeros((N, N))
    single = counts.sum(axis=1, keepdims=True) + 0.5  # back off from pairs to single characters
    single /= single.sum(axis=2, keepdims=True)
    smooth = (counts + BACK_OFF * single) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    return np.log(smooth[1]) - np.log(smooth[0])


def _doubtful(token: str) -> bool:
    """Long and with a digit or a long run of letters: it could be random, so it teaches neither model."""
    return len(token) >= MIN_LENGTH and (any(c.isdigit() for c in token) or max(map(len, re.split("[_-]", token))) >= MIN_LENGTH)


def model_spans(text: str, ratios: np.ndarray, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tokens outside the taken spans that are likelier random than ordinary."""
    out = []
    for m in _outside(CANDIDATE.finditer(text), taken):
        a, b = m.span()
        score = float(ratios[_steps(m[0])].sum())
        if score >= MIN_RATIO and score >= MIN_MEAN * (b - a):
            out.append(("markov", a, b))
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", ratios: np.ndarray | None = None) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end; by start, then kind in the order assign, access, hex, markov)."""
    flat = (train(docs, text, key) if ratios is None else ratios).ravel()
    order = {k: i for i, k in enumerate((*BASE_KINDS, "markov"))}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame["text"]:
                spans = base_spans(t)
                spans += model_spans(t, flat, spans)
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]]))])
            yield pd.DataFrame({"key": frame["key"], "spans": rows})

    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.struct(F.col(key).alias("key")).alias("key"), text_or_empty(text).alias("text"))
    out = keyed.mapInPandas(run, f"key struct<key:{kind}>, spans {SPANS}")
    return out.select(F.col("key.key").alias(key), "spans")
