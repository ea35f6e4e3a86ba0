"""Byte-level BPE encoding and decoding.

Spark folds the merges.  Tasks split their texts into pieces and keep each distinct piece of a block of texts once, as
an array of byte tokens.  Higher-order functions then fold every distinct piece: each step looks up the rank of all
adjacent pairs in a literal map and merges the first pair of least rank, until none has a rank.  The map is two
literal arrays, a row-displaced table: the row of the left token starts at ``shift[left]``, the entry of the right
token is ``right`` further on and names its owner.  Decoding concatenates the binary pieces of the ids; ids and bytes of
a text are gathered from those of its pieces by array operations.

No shuffle: pieces are distinct per block (at most ``BLOCK_CHARS`` code points of text, or one longer text), so the
fold costs the sum of the blocks' vocabularies and the plan stays narrow whatever the table's size.  Pieces over
``LONG_PIECE`` bytes, where re-scanning all pairs would be quadratic, are merged with a heap instead.

Pieces that most blocks share are folded once beforehand: the ``CACHE_PIECES`` most frequent pieces of about
``CACHE_DOCS`` documents, drawn by hash (a share of those as frequent as the last that has room).  This is a cache of bounded size; it changes no result.

Edge cases: a null or empty text has no tokens and decodes to nothing.  Order, repeated rows and ties need no rule: the
result depends on the text alone.  An empty table gives no rows.  Extra columns are ignored; the output has the
given key column, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeflow.llm import pretokens
from regimeflow.llm.common import save, text_or_empty
from regimeflow.llm.rank_map import RankMap

BLOCK_CHARS, LONG_PIECE = 5 << 20, 128
GATHERED, SLICE_ROWS = 1 << 16, 256
CACHE_DOCS, CACHE_PIECES, SAMPLE_CHARS = 12_288, 300_000, 1 << 20
Ranks = dict[bytes, int]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_level(ranks: Ranks) -> tuple[RankMap, np.ndarray]:
    """The map of all pairs whose concatenation has a rank, and the token of every byte."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    return RankMap(rows, max(ranks.values()) + 1), np.array([ranks[bytes([b])] for b in range(256)], np.int32)


def _literal(values: np.ndarray, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def fold_merges(ids: Column, ranks: RankMap) -> Column:
    """The fold: an array of byte tokens becomes the array of merged tokens.

    An entry of the literal map is its owner and its rank in one number.  With the left token's bits turned it is the
    rank, or far larger (the sign bit goes) where another token owns the place, so the least of a piece is the rank to
    merge at.  Every plan carries the map and every print of a plan spells it out, so numbers are as short as ranks allow.
    """
    bits = max(int(ranks.rank_at.max(initial=0)).bit_length(), 1)
    entries = np.where(ranks.owner >= 0, (ranks.owner.astype(np.int64) << bits) | ranks.rank_at, -1)
    last = int(np.flatnonzero(ranks.owner >= 0).max(initial=-1)) + 1
    table, shift = _literal(entries[:last], "bigint"), _literal(ranks.shift, "int")

    def rank(left: Column, right: Column) -> Column:
        return F.get(table, F.get(shift, left) + right).bitwiseXOR(F.shiftleft(left.cast("bigint"), bits)).bitwiseAND(F.lit((1 << 63) - 1))

    def merge(state: Column, _: Column) -> Column:
        pairs = F.transform(state, lambda x, i: rank(x, F.get(state, i + 1)))

        def merged(p: Column, least: Column) -> Column:
            at = F.array_position(p, least).cast("int")
            return F.when(least < (1 << bits), F.concat(
                F.slice(state, 1, at - 1), F.array(least.cast("int")), F.slice(state, at + 2, F.size(state)))).otherwise(state)

        # arrays of one: what they hold is worked out once
        return F.transform(F.array(pairs), lambda p: F.transform(F.array(F.array_min(p)), lambda least: merged(p, least))[0])[0]

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(2)) - 1), ids, merge)


def merge_long(ids: list[int], ranks: Ranks, pieces: dict[int, bytes]) -> list[int]:
    """The same merges for one long piece, in n log n: a heap of pairs over a linked list."""
    n = len(ids)
    token, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := ranks.get(pieces[token[i]] + pieces[token[j]])) is not None:
            heapq.heappush(heap, (r, i, token[i], token[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        if not alive[i] or token[i] != a or (j := right[i]) >= n or token[j] != b:
            continue
        token[i], alive[j], right[i] = r, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [t for t, live in zip(token, alive, strict=True) if live]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[str]]]:
    keys, texts, size, kind = [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for part in (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS)):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if texts and size + len(text) > limit:
                    yield pa.array(keys, kind), texts
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
    if texts:
        yield pa.array(keys, kind), texts


Cache = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted keys of pieces; where the ids of each begin; all ids
NO_CACHE: Cache = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))


def _split_block(keys: pa.Array, texts: list[str], byte_ids: np.ndarray, ranks_path: str, cache: Cache = NO_CACHE) -> pa.RecordBatch:
    code = pretokens.codes("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    text_starts = np.cumsum(sizes) - sizes
    if len(code):
        begin = pretokens.piece_starts(code, text_starts[sizes > 0])
        end = np.append(begin[1:], len(code))
        piece_keys, where, which = np.unique(pretokens.span_keys(code, begin, end), return_index=True, return_inverse=True)
        begin_d, end_d = begin[where], end[where]
    else:
        begin = begin_d = end_d = which = np.empty(0, np.int64)
        piece_keys = np.empty(0, np.uint64)
    cached_keys, cached_at, cached_ids = cache
    slot = np.searchsorted(cached_keys, piece_keys)
    merged = np.zeros(len(piece_keys), bool)
    inside = slot < len(cached_keys)
    merged[inside] = cached_keys[slot[inside]] == piece_keys[inside]
    hit, known = np.flatnonzero(merged), slot[merged]
    whole = "".join(texts)
    todo = np.flatnonzero(~merged)
    raw = [whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begin_d[todo].tolist(), end_d[todo].tolist(), strict=True)]
    size = np.array([len(w) for w in raw], np.int64)
    start = np.cumsum(size) - size
    # the ids of every piece lie in one of three stretches: bytes to fold, long pieces merged here, cached pieces
    pool = [byte_ids[np.frombuffer(b"".join(raw), np.uint8)], np.zeros(0, np.int32), cached_ids]
    first, count = np.zeros(len(piece_keys), np.int64), np.zeros(len(piece_keys), np.int64)
    first[todo], count[todo] = start, size
    if (long := np.flatnonzero(size > LONG_PIECE)).size:
        ranks = read_ranks(ranks_path)
        pieces = {r: t for t, r in ranks.items()}
        done = [np.array(merge_long(pool[0][start[i]:start[i] + size[i]].tolist(), ranks, pieces), np.int32) for i in long]
        lengths = np.array([len(d) for d in done])
        pool[1] = np.concatenate(done)
        first[todo[long]], count[todo[long]] = len(pool[0]) + np.cumsum(lengths) - lengths, lengths
        merged[todo[long]] = True
    first[hit], count[hit] = cached_at[known] + len(pool[0]) + len(pool[1]), cached_at[known + 1] - cached_at[known]
    at = np.concatenate(([0], np.cumsum(count)))
    flat = np.concatenate(pool)[np.repeat(first - at[:-1], count) + np.arange(at[-1])]
    words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
    per_text = np.searchsorted(begin, np.append(text_starts, len(code)))
    which = which.astype(np.int32)
    coded = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(which, pa.int32()))
    one = pa.array([0, len(keys)], pa.int32())
    all_words = pa.array([0, len(piece_keys)], pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, coded),
        pa.ListArray.from_arrays(all_words, words), pa.ListArray.from_arrays(all_words, pa.array(merged))], ["keys", "coded", "words", "merged"])


def frequent_pieces(docs: DataFrame, ranks_path: str, table: RankMap, byte_ids: np.ndarray, text: str, key: str) -> Cache:
    """The cache: pieces of sampled documents by the number of sample blocks that hold them, folded; about ``CACHE_PIECES``.

    Keys of pieces are made in tasks, so that the driver holds numbers alone.
    """
    n = docs.count()
    if n < CACHE_DOCS:
        return NO_CACHE
    share = CACHE_DOCS / n
    some = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def split(batches):
        for keys, texts in _blocks(batches, SAMPLE_CHARS):
            yield _split_block(keys, texts, byte_ids, ranks_path)

    held = some.select(F.lit("").alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        split, "keys array<string>, coded array<array<int>>, words array<array<int>>, merged array<boolean>")
    each = held.select(F.explode(F.arrays_zip("words", "merged")).alias("p")).where(~F.col("p.merged")).select(F.col("p.words").alias("piece"))
    counted = save(each.groupBy("piece").agg(F.count("*").alias("n")), "pieces")
    # A row per count of blocks: the count from which on all pieces have room, and the share of those one below.
    edge, part, room = 0, 0.0, CACHE_PIECES
    for times, pieces in sorted(((r["n"], r["pieces"]) for r in counted.groupBy("n").agg(F.count("*").alias("pieces")).collect()), reverse=True):
        if pieces > room:
            edge, part = times, room / pieces
            break
        room -= pieces
    drawn = F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < int(part * (1 << 20))
    common = counted.where((F.col("n") > edge) | ((F.col("n") == edge) & drawn)).select("piece")
    byte_of = np.zeros(int(byte_ids.max()) + 1, np.uint8)
    byte_of[byte_ids] = np.arange(256)

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch.column(0)
            raw, size = byte_of[pieces.flatten().to_numpy()].tobytes(), pieces.value_lengths().to_numpy()
            end = np.cumsum(size)
            texts = [raw[e - s:e].decode("utf-8", "surrogatepass") for e, s in zip(end.tolist(), size.tolist(), strict=True)]
            sizes = np.array([len(t) for t in texts], np.int64)
            code_end = np.cumsum(sizes)
            found = pretokens.span_keys(pretokens.codes("".join(texts)), code_end - sizes, code_end).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1)], ["key", "ids"])

    # Written first, a file per task: above an exchange the fold would be in a plan that is planned, and printed, again and
    # again while it runs, and each print of the literal map takes tens of megabytes of the driver's heap.
    spread = save(common.repartition(docs.sparkSession.sparkContext.defaultParallelism), "common-pieces")
    rows = spread.select("piece", fold_merges(F.col("piece"), table).alias("ids")).mapInArrow(keyed, "key long, ids array<int>").toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    ids = rows.column("ids").combine_chunks()
    order = np.argsort(keys)
    lengths = ids.value_lengths().to_numpy().astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    flat, at = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths[order])))
    take = np.repeat(begin[order] - at[:-1], lengths[order]) + np.arange(at[-1])
    return keys[order], at, flat[take].astype(np.int32)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` and ``decoded`` of every text, by the ranks of the file at ``ranks_path``."""
    ranks = read_ranks(ranks_path)
    table, byte_ids = byte_level(ranks)
    name = docs.schema[key].dataType.simpleString()
    cache = frequent_pieces(docs, ranks_path, table, byte_ids, text, key)
    held = docs.sparkSession.sparkContext.broadcast(cache)  # bounded by CACHE_PIECES

    def split(batches):
        for keys, texts in _blocks(batches, block_chars):
            yield _split_block(keys, texts, byte_ids, ranks_path, held.value)

    blocks = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        split, f"keys array<{name}>, coded array<array<int>>, words array<array<int>>, merged array<boolean>")
    kind = docs.schema[key].dataType.simpleString()
    folded = blocks.select("keys", "coded", F.zip_with("words", "merged", lambda w, done: F.when(done, w).otherwise(fold_merges(w, table))).alias("ids"))

    def put_together(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _texts(*(batch.column(c)[i].values for c in ("keys", "coded", "ids")), token_bytes(ranks_path))

    out = folded.mapInArrow(put_together, f"key {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)


Bytes = tuple[np.ndarray, np.ndarray, np.ndarray]  # all tokens' bytes; where each begins; how many it has


@lru_cache(maxsize=4)
def token_bytes(path: str) -> Bytes:
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    blob = b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1]))
    return np.frombuffer(blob, np.uint8), np.cumsum(size) - size, size


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches ``first`` .. ``first + count`` of the values one after the other, where each ends)."""
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, values.dtype)
    for a in range(0, len(count), GATHERED):  # places are 64-bit numbers, of which only some are held at once
        some = slice(a, a + GATHERED)
        done = int(end[a] - count[a])
        at = np.repeat((first[some] - (end[some] - count[some] - done)).astype(np.int64), count[some])
        at += np.arange(len(at))
        out[done:done + len(at)] = values[at]
    return out, end


def _texts(keys: pa.Array, coded: pa.Array, words: pa.Array, tokens: Bytes) -> pa.RecordBatch:
    """Ids and bytes of the texts of one block: those of its pieces, one after the other."""
    sizes, piece_ids = words.value_lengths().to_numpy().astype(np.int64), words.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    plain, ends = _gathered(tokens[0], tokens[1][piece_ids], tokens[2][piece_ids])  # the distinct pieces, decoded
    ends = np.concatenate(([0], ends))
    plain_at = ends[starts]
    plain_size = ends[starts + sizes] - plain_at
    which, per_text = coded.flatten().to_numpy(), coded.value_lengths().to_numpy()
    edge = np.concatenate(([0], np.cumsum(per_text)))

    def column(values: np.ndarray, first: np.ndarray, count: np.ndarray, item: int) -> tuple[pa.Array, np.ndarray]:
        data, end = _gathered(values, first[which], count[which])
        offsets = np.concatenate(([0], end))[edge] * item
        array = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return array, np.diff(offsets) // item

    ids, n_tokens = column(piece_ids.astype("<u4"), starts, sizes, 4)
    decoded, _ = column(plain, plain_at, plain_size, 1)
    return pa.RecordBatch.from_arrays([keys, pa.array(n_tokens), ids, decoded], ["key", "n_tokens", "ids", "decoded"])
