"""Packing: ids against the tokenizers library, the placing of every piece, and the number of sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from regimeflow.llm import packing as K
from regimeflow.shipping import ship_package
from tests.llm import brute

FILE = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, capacity):
    """Per row its pieces (piece, start, length, crc), by the tokenizers library."""
    library = tokenizers.Tokenizer.from_file(FILE)
    out = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity):
    """Offsets are gapless in every sequence; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, capacity):
    ship_package(spark)
    rows = [r[:2] for r in brute.documents()]
    rows += [(None, "no id"), (3, rows[3][1]), (3, "another <|endoftext|> of this id"), (9, None), (5000, "many words " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, `key` string").repartition(5)
    out = K.pack(docs, FILE, capacity).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == expected(rows, capacity)
    n = check_places(out, capacity)
    least = -(-sum(r["length"] for r in out) // capacity)
    assert least <= n <= least * 1.02 + 1


def test_nothing_and_one_piece(spark):
    ship_package(spark)
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
    one = K.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), FILE).collect()
    assert [(r["piece"], r["start"], r["length"], r["offset"]) for r in one] == [(0, 0, 1, 0)]


def test_hot_length_spreads_over_tasks(spark):
    ship_package(spark)
    docs = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one text', concat('other ', id)) AS text").repartition(7)
    out = K.pack(docs, FILE, 64).collect()
    assert check_places(out, 64) <= -(-sum(r["length"] for r in out) // 64) + 2 and len(out) == 9000


def test_knapsack_price_is_exact():
    rng = np.random.default_rng(1)
    value = np.full(41, -np.inf)
    for length in rng.choice(np.arange(3, 41), 9, replace=False):
        value[length] = rng.integers(1, 50)
    want = [0.0] * 41
    for room in range(1, 41):
        want[room] = max([want[room - 1], *(want[room - a] + value[a] for a in range(1, room + 1))])
    assert K.price(value, 40).tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    counts[rng.choice(np.arange(1, 257), 60, replace=False)] = rng.integers(1, 3000, 60)
    plan = K.plan(counts, 256)
    length = np.repeat(np.arange(257), counts)
    number = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = plan.place(length, number)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset[first] == 0).all() and (offset[1:] == offset[:-1] + length[:-1])[~first[1:]].all()
    assert (offset + length).max() <= 256 and len(np.unique(sequence)) == plan.n_sequences
    tokens = (counts * np.arange(257)).sum()
    assert max(-(-tokens // 256), counts[129:].sum()) <= plan.n_sequences <= 1.01 * sum(n for _, n in K.best_fit(counts, 256))


def test_linear_program_beats_volume_only_where_it_can():
    """Lengths of which only some combinations fill a sequence: the optimum is known."""
    counts = np.zeros(101, np.int64)
    counts[[51, 27, 22, 49, 26, 25]] = 6000  # 51 + 27 + 22, 51 + 49, 49 + 26 + 25
    solution, covered = K.fractional_cover(counts, 100, steps=2000, rate=0.1)
    low = covered[counts > 0].min()
    assert all(sum(a * n for a, n in config) <= 100 for config in solution)
    assert 12_000 <= sum(solution.values()) / low <= 1.05 * 12_000
    whole, left = K.round_down(solution, low, counts)
    for config, copies in whole:
        for a, n in config.items():
            left[a] += n * copies
    assert (left == counts).all()
    assert K.plan(counts, 100, steps=2000, rate=0.1).n_sequences <= 1.02 * 12_000


def test_best_fit_is_the_plain_best_fit():
    rng = np.random.default_rng(3)
    counts = np.zeros(65, np.int64)
    counts[rng.choice(np.arange(1, 65), 20, replace=False)] = rng.integers(1, 40, 20)
    rooms = []
    for length in range(64, 0, -1):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            room = min(fit) if fit else 64
            if fit:
                rooms.remove(room)
            rooms.append(room - length)
    bins = K.best_fit(counts, 64)
    assert sum(n for _, n in bins) == len(rooms)
    assert sorted(64 - sum(a * k for a, k in c.items()) for c, n in bins for _ in range(n)) == sorted(rooms)
