"""Token counts by a compiled finite-state tokenizer.

*Words.*  A BPE vocabulary is a deterministic transducer over symbols: after any prefix of a word its encoding ends in
one known token, and the next symbol's transition replaces or adds tokens, so it carries an emitted count.  The
transition is found among the vocabulary tokens that end at the new symbol: exactly one of them may follow the last
token of the prefix before it (two tokens may be neighbours unless the merges would have joined parts of them first,
see ``WordTransducer.compatible``).  The transducer runs over all distinct words of a block side by side, position
by position, in linear time; merges are never replayed.

*Texts.*  White space separates words for good, so a chunk of text is summed up by a state map: the words that may
still grow to the left (head) and to the right (tail) and the count emitted between them, or, without white space, the
open text itself.  Maps compose associatively; the maps of a text's chunks are composed pairwise, level by level, as in
a parallel prefix scan.

One narrow pass, no shuffle.  Edge cases: a null or empty text has 0 bytes and 0 tokens; white space alone has none;
repeated rows and ties need no rule, and an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeflow.llm import pretokens
from regimeflow.llm.common import text_or_empty
from regimeflow.llm.rank_map import NO_RANK, RankMap

CHUNK, BLOCK, LONG_WORD, LIMIT = 1 << 15, 4 << 20, 200, 2048
END = 256  # a symbol is a byte; the last one of a word has END added
_BASE = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point by the Unicode tables of the library."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((pretokens.LETTER, r"\p{L}"), (pretokens.NUMBER, r"\p{N}"), (pretokens.SPACE, r"\s")):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        out[pretokens.codes("".join(p for p, _ in split.pre_tokenize_str(every)))] = kind
    return out


@lru_cache(maxsize=1)
def _own_case() -> dict[int, str]:
    """Code points that the library lower-cases unlike Python does letter by letter."""
    rule = tokenizers.normalizers.Lowercase()
    every = "\n".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    pairs = zip(every.split("\n"), rule.normalize_str(every).split("\n"), strict=False)
    return {ord(a): b for a, b in pairs if len(a) == 1 and a.lower() != b}


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.translate(_own_case()).replace("Σ", "σ").lower()


class WordTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in whole["added_tokens"]]
        shown = {c: b for b, c in _byte_signs().items()}
        n = max(vocab.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.born = np.full(n, -1)  # rank of the merge that makes the token
        self.merged = np.full(len(model["merges"]), -1)
        rows: dict[int, list[tuple[int, int]]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            rows.setdefault(left, []).append((right, rank))
            self.left[made], self.right[made], self.born[made], self.merged[rank] = left, right, rank, made
        self.pairs = RankMap(rows, n)
        symbols = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            s = [shown[c] for c in (token[:-len(suffix)] if ends else token)]
            if ends:
                s[-1] += END
            if len(s) == 1 or self.born[i] >= 0:
                symbols[i] = np.array(s, np.uint64)
        self.longest = max(map(len, symbols.values()))
        ids = np.array(list(symbols))
        keys = np.array([_key(s) for s in symbols.values()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys & np.uint64((1 << 22) - 1)] = True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay neighbours.

        Undo the later of the two merges that made the tokens at the border, until both are symbols: the pair then at
        the border must not have a merge that comes before either of the undone ones (at equal rank the left one is first).
        """
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), NO_RANK)
        until_b = until_a.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pairs.ranks(x, y)
            bad = (r < until_a[live]) & (r <= until_b[live]) & (r < NO_RANK)
            ok[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[go], x[go], y[go], bx[go], by[go]
            undo_left = bx > by
            one, two = live[undo_left], live[~undo_left]
            until_a[one], a[one] = bx[undo_left], self.right[x[undo_left]]
            until_b[two], b[two] = by[~undo_left], self.left[y[~undo_left]]
        return ok

    def counts(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word; ``symbols`` holds the words one after another, ``size`` symbols each."""
        start = np.cumsum(size) - size
        out = np.zeros(len(size), np.int64)
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            out[w] = self._long(symbols[start[w]:start[w] + size[w]])
        short = np.flatnonzero(size <= LONG_WORD)
        if not len(short):
            return out
        if len(short) < len(size):
            symbols = symbols[np.repeat(size <= LONG_WORD, size)]
            size = size[short]
            start = np.cumsum(size) - size
        n = len(symbols)
        place = np.arange(n) - np.repeat(start, size)
        where, length, token = [], [], []
        key = np.zeros(n, np.uint64)
        reach = np.arange(n)
        for m in range(1, self.longest + 1):  # key of the m symbols that end here, from the first backwards
            reach = reach[place[reach] >= m - 1]
            if not len(reach):
                break
            key[reach] = key[reach] * _BASE + symbols[reach - (m - 1)].astype(np.uint64) + np.uint64(1)
            k = key[reach]
            maybe = self.seen[k & np.uint64((1 << 22) - 1)]
            at, k = reach[maybe], k[maybe]
            found = np.searchsorted(self.keys, k)
            hit = self.keys[np.minimum(found, len(self.keys) - 1)] == k
            where.append(at[hit])
            length.append(np.full(int(hit.sum()), m, np.int32))
            token.append(self.ids[found[hit]])
        where, length, token = map(np.concatenate, (where, length, token))
        step = np.argsort(place[where], kind="stable")
        where, length, token = where[step], length[step], token[step]
        bounds = np.searchsorted(place[where], np.arange(int(size.max()) + 1))
        last, count = np.full(n, -1), np.zeros(n, np.int64)
        for p in range(int(size.max())):
            w, m, t = (x[bounds[p]:bounds[p + 1]] for x in (where, length, token))
            whole = m == p + 1
            before = np.where(whole, 0, last[np.maximum(w - m, 0)])
            ok = whole.copy()
            rest = np.flatnonzero(~whole)
            ok[rest] = self.compatible(before[rest], t[rest])
            w, m, t, whole = w[ok], m[ok], t[ok], whole[ok]
            last[w] = t
            count[w] = np.where(whole, 0, count[np.maximum(w - m, 0)]) + 1
        out[short] = count[start + size - 1]
        return out

    def _long(self, symbols: np.ndarray) -> int:
        """The same transitions for one long word, with the neighbours already judged kept."""
        index = self.__dict__.setdefault("_index", dict(zip(self.keys.tolist(), self.ids.tolist(), strict=True)))
        judged = self.__dict__.setdefault("_judged", {})
        mask, base = (1 << 64) - 1, int(_BASE)
        s = symbols.tolist()
        last, count = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for i in range(1, len(s) + 1):
            key = 0
            for m in range(1, min(self.longest, i) + 1):
                key = (key * base + s[i - m] + 1) & mask
                t = index.get(key)
                if t is None:
                    continue
                if m < i:
                    pair = (last[i - m], t)
                    if pair not in judged:
                        judged[pair] = bool(self.compatible(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if not judged[pair]:
                        continue
                last[i], count[i] = t, count[i - m] + 1
                break
        return count[-1]


def _key(symbols: np.ndarray) -> np.uint64:
    key = np.uint64(0)
    with np.errstate(over="ignore"):
        for s in symbols[::-1]:
            key = key * _BASE + s + np.uint64(1)
    return key


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in the vocabulary file: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def compiled(path: str) -> WordTransducer:
    return WordTransducer(path)


def count_texts(texts: list[str], machine: WordTransducer) -> np.ndarray:
    """Emitted tokens of each text, taken as a whole."""
    out = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        cut = [text]
        for special in machine.special:
            if special in text:
                out[i] += sum(p.count(special) for p in cut)
                cut = [q for p in cut for q in p.split(special)]
        for p in cut:
            if p:
                parts.append(normal(p))
                owner.append(i)
    code = pretokens.codes("".join(parts))
    if not len(code):
        return out
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    kind = classes()[code]
    begin = pretokens.piece_starts(code, starts[sizes > 0], kind, blanks_join=False, single_numbers=True)
    end = np.append(begin[1:], len(code))
    word = kind[begin] != pretokens.SPACE
    begin, end = begin[word], end[word]
    if not len(begin):
        return out
    _, where, which = np.unique(pretokens.span_keys(code, begin, end), return_index=True, return_inverse=True)
    whole = "".join(parts)
    raw = [whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
    size = np.array([len(r) for r in raw], np.int64)
    symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
    symbols[np.cumsum(size) - 1] += END
    emitted = machine.counts(symbols, size)[which]
    text_of = np.array(owner)[np.searchsorted(starts, begin, side="right") - 1]
    return out + np.bincount(text_of, emitted, len(texts)).astype(np.int64)


# ------------------------------------------------------------------------------------------------ state maps of chunks

def chunk_map(chunk: str) -> tuple[str, str, str] | str:
    """(head, middle, tail) around the first and the last white space; the chunk itself where there is none."""
    space = classes()[pretokens.codes(chunk)] == pretokens.SPACE
    at = np.flatnonzero(space)
    return (chunk[:at[0]], chunk[at[0]:at[-1] + 1], chunk[at[-1] + 1:]) if len(at) else chunk


def compose(a, b, seams: list[str]):
    """The map of two neighbouring chunks; a word closed between them goes to ``seams``."""
    if isinstance(a, str):
        return a + b if isinstance(b, str) else (a + b[0], b[1])
    if isinstance(b, str):
        return a[0], a[1] + b
    seams.append(a[1] + b[0])
    return a[0], b[1]


def scan(maps: list, seams: list[str]):
    """Composes neighbours, then neighbours of the results, until one map is left."""
    while len(maps) > 1:
        pairs = [compose(a, b, seams) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = pairs + maps[len(maps) - len(maps) % 2:]
    return maps[0]


def count_block(texts: list[str], machine: WordTransducer, chunk: int = CHUNK) -> np.ndarray:
    pieces, owner = [], []
    for i, text in enumerate(texts):
        if len(text) <= chunk:
            pieces.append(text)
            owner.append(i)
            continue
        maps = []
        for at in range(0, len(text), chunk):
            m = chunk_map(text[at:at + chunk])
            if not isinstance(m, str):
                pieces.append(m[1])
                owner.append(i)
                m = (m[0], m[2])
            maps.append(m)
        seams: list[str] = []
        left = scan(maps, seams)
        seams.extend([left] if isinstance(left, str) else left)  # nothing stands before or after the text
        pieces.extend(seams)
        owner.extend([i] * len(seams))
    counts = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(pieces):
        end, size = first, 0
        while end < len(pieces) and (end == first or size + len(pieces[end]) <= BLOCK):
            size += len(pieces[end])
            end += 1
        np.add.at(counts, owner[first:end], count_texts(pieces[first:end], machine))
        first = end
    return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = count_block(texts, machine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "n"])

    whole = text_or_empty(text)
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.struct(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("bytes")).alias("key"), whole.alias("text"))
    out = keyed.mapInArrow(run, f"key struct<key:{kind},bytes:bigint>, n long")
    return out.select(F.col("key.key").alias(key), F.col("key.bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
