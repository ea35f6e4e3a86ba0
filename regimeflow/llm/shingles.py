"""Word shingles of many texts at once, as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from regimeflow.llm.pretokens import span_keys

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts (A-Z lower-cased), begin and end of every word (cut at ASCII white space), and where the words of each text begin."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[data]
    word = ~space
    begin = np.flatnonzero(word[1:] & space[:-1]) + 1
    if len(word) and word[0]:
        begin = np.concatenate(([0], begin))
    end = np.flatnonzero(space[1:] & word[:-1]) + 1
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return data, begin, end, np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes))))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where the words of each begin."""
    data, begin, end, at = word_spans(texts)
    return span_keys(data, begin, end), at


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and where those of each text begin; a shorter text is one shingle as a whole."""
    key, at = words(texts)
    key = mix(key)
    n = len(key)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        if n > i:
            out[:n - i] = mix(out[:n - i] * _M1 + key[i:] + np.uint64(1))
    count = np.maximum(np.diff(at) - width + 1, 0)
    short = np.flatnonzero((np.diff(at) > 0) & (count == 0))
    count[short] = 1
    begin = np.cumsum(count) - count
    take = np.repeat(at[:-1] - begin, count) + np.arange(int(count.sum()))
    result = out[take]
    for t in short:
        k = np.zeros(1, np.uint64)
        for x in key[at[t]:at[t + 1]]:
            k = mix(k * _M2 + x + np.uint64(width))
        result[begin[t]] = k[0]
    return result, np.concatenate((begin, [len(result)]))
