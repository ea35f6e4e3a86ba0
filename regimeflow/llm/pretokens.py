"""Splitting texts into pretokens with array operations: the code points of many texts at once, no regex per match."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
PLANE = 0x800  # code points classified at once: a worker that has just started stays small; surrogates are whole planes
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the public pattern, after an apostrophe
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, by the Unicode tables of the tokenizer library."""
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matched = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for at in range(0, 0x110000, PLANE):
            if not 0xD800 <= at < 0xE000:
                some = "".join(map(chr, range(at, at + PLANE)))
                out[codes(bytes(matched.encode_ordinary(some)).decode())] = kind
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def piece_starts(code: np.ndarray, text_starts: np.ndarray, kind: np.ndarray | None = None, blanks_join: bool = True,
                 single_numbers: bool = False) -> np.ndarray:
    """Where pieces of the byte-level pattern begin, in the concatenated code points of texts.

    A piece is a contraction, a run of letters, of numbers or of other signs with one leading blank, or white space;
    of white space before such a run, the last character stands apart (a blank joins the run).  Without
    ``blanks_join`` white space stays by itself; with ``single_numbers`` every number is a piece.
    """
    n = len(code)
    kind = classes()[code] if kind is None else kind
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first = first[:n]
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first
    if single_numbers:
        start |= kind == NUMBER
    last = np.empty(n, bool)  # the next character is of another text or there is none
    last[-1:] = True
    last[:-1] = first[1:]
    if blanks_join:
        space = kind == SPACE
        before_run = np.zeros(n, bool)  # last white space in front of something else
        before_run[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
        start |= before_run
        start[np.flatnonzero(before_run & (code == 32)) + 1] = False
    apostrophe = np.flatnonzero((code == 39) & start & ~last)  # a piece of its own: nothing glued in front
    if len(apostrophe):
        apostrophe = apostrophe[kind[apostrophe + 1] == LETTER]
        a = code[apostrophe + 1]
        b = np.where(apostrophe + 2 < n, code[np.minimum(apostrophe + 2, n - 1)], 0)
        b = np.where(last[apostrophe + 1], 0, b)
        size = np.zeros(len(apostrophe), np.int64)
        for c in CONTRACTIONS:
            hit = (a == ord(c[0])) & ((b == ord(c[1])) if len(c) == 2 else True) & (size == 0)
            size[hit] = len(c)
        apostrophe, size = apostrophe[size > 0], size[size > 0]
        start[apostrophe + 1] = False
        rest = apostrophe + 1 + size
        inside = rest[(rest < n)]
        start[inside] = True
    return np.flatnonzero(start)


def span_keys(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key per span of code points, equal for equal spans.

    Spans of up to 64 code points are hashed side by side, one position at a time; the few longer ones one by one.
    """
    size = (end - begin).astype(np.int64)
    key = (size.astype(np.uint64) + np.uint64(1)) * _MUL
    order = np.argsort(-np.minimum(size, 65), kind="stable")
    by_size = -np.minimum(size, 65)[order]
    for at in range(64):
        live = order[:np.searchsorted(by_size, -at, side="left")]
        if not len(live):
            break
        k = key[live] ^ code[begin[live] + at].astype(np.uint64)
        k *= _MUL
        k ^= k >> np.uint64(29)
        key[live] = k
    for i in order[:np.searchsorted(by_size, -64, side="left")]:
        key[i] = _long_key(code[begin[i]:end[i]])
    return key


def _long_key(span: np.ndarray) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(np.ascontiguousarray(span).tobytes()))
