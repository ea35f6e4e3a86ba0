"""Conversation structure repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from regimeflow.llm import conversation_repair as R

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def best_edits(rows):
    """(cost, audit) of ``(must go, truncated, initial)`` rows: every way from every state, from the end."""
    @lru_cache(None)
    def rest(i, last):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, ""))
        if i < len(rows):
            gone, cut, initial = rows[i]
            c, e = rest(i + 1, last)
            ways.append((c + 2, "D" + e))
            if not gone:
                for to in FOLLOWS[last]:
                    if to == initial:
                        c, e = rest(i + 1, to)
                        ways.append((c + 5 * cut, "K" + e))
                    if to in "ua":
                        c, e = rest(i + 1, to)
                        ways.append((c + 1 + 5 * cut, "R" + e))
        return min(ways + inserted(i, last), default=(10**9, ""))

    def inserted(i, last, depth=2):
        """Up to two inserted rows, then something else; more only come back to a state."""
        out = []
        for to in FOLLOWS[last]:
            if to in "ua" and depth:
                out += [(c + 5, "I" + e) for c, e in direct(i, to) + inserted(i, to, depth - 1)]
        return out

    def direct(i, last):
        if i == len(rows):
            return [(0, "")] if last in ("", "a") else []
        gone, cut, initial = rows[i]
        out = [(c + 2, "D" + e) for c, e in [rest(i + 1, last)]]
        for to in FOLLOWS[last] if not gone else "":
            c, e = rest(i + 1, to)
            out += [(c + 5 * cut, "K" + e)] if to == initial else []
            out += [(c + 1 + 5 * cut, "R" + e)] if to in "ua" else []
        return out

    return rest(0, "")


def play(rows, audit):
    """The repaired (role, text) rows that an audit stands for."""
    out, i = [], 0
    for edit in audit:
        last = out[-1][0][:1] if out else ""
        wanted = {"u": "assistant"}.get(last, "user")
        if edit == "I":
            out.append((wanted, ""))
            continue
        role, text = rows[i]
        i += 1
        if edit != "D":
            out.append((role if edit == "K" else wanted, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def brute_report(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            rows.append((turn, " " if role is None else role, " " if text is None else text))
        seen, counts, faults = set(), Counter(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            faults.append((fault in ("blank", "duplicate"), fault == "truncated", role[:1]))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = best_edits(tuple(faults))
        left = play([r[1:] for r in rows], audit)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def brute_damage(table):
    out = []
    for conv, turn, role, text in table:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [] if fault == 0 else [row, row] if fault == 3 else [row]
    return out


def random_rows(seed, n, conversations=3):
    rng = random.Random(seed)
    words = ["a.", "b.", "c!", "d?", "e", "", " \t", "long one.", "f", None]
    return [(rng.choice([*range(conversations), None]), rng.choice([*range(n), None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
             rng.choice(words) if rng.random() < 0.6 else f"text {i}.") for i in range(n)]


def reported(spark, table, block_rows=R.BLOCK):
    df = spark.createDataFrame(table, SCHEMA)
    rows = R.with_empty(R.report(R.repair(df, block_rows)), df).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("DTKKKK"), rng.choice(["s", "u", "a", "u", "a", "x"])) for _ in range(rng.randint(0, 14))]
    done = list(R.solve([(i, kind, initial, 1) for i, (kind, initial) in enumerate(rows)]))
    want = best_edits(tuple((k == "D", k == "T", i) for k, i in rows))
    assert (sum(d[3] for d in done), "".join(d[1] for d in done)) == (want if rows else (0, ""))
    assert [d[0] for d in done] == list(range(len(rows)))


def test_survivors_hold_only_what_is_open():
    search = R.Survivors()
    settled = 0
    for i in range(20_000):
        settled += len(search.step(R.row_moves("K", "ua"[i % 2], 1), i))
    depth, node = 0, next(iter(search.live.values()))[1]
    while node is not search.root:
        depth, node = depth + 1, node.parent
    assert settled + depth == 20_000 and depth < 50


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 65_536), (2, 1), (3, 2), (4, 5)])
def test_report_equals_brute_force(spark, seed, block_rows):
    table = random_rows(seed, 40)
    assert reported(spark, table, block_rows) == brute_report(table)


def test_damage_equals_brute_force(spark):
    table = random_rows(7, 60, 20)
    got = R.damaged(spark.createDataFrame(table, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_damage(table))


def test_odd_tables(spark):
    assert reported(spark, []) == {}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    conversations = spark.createDataFrame([(1,), (None,)], "conv_id long")
    empty = spark.createDataFrame([], SCHEMA)
    assert {r["conv_id"]: tuple(r)[1:] for r in R.with_empty(R.report(R.repair(empty)), conversations).collect()} == {1: nothing, None: nothing}
    long = "word " * 200_000 + "."
    table = [(5, 1, "user", long), (5, 2, "assistant", long), *[(5, 3, "user", "again.")] * 50, (5, 4, "assistant", "so.")]
    got = reported(spark, table)
    assert got == brute_report(table) and got[5][6] == "KKK" + "D" * 49 + "K"


def test_extra_columns_and_key_types(spark):
    rows = spark.createDataFrame([("x", 1, "user", "a.", 1, "u"), ("x", 2, "assistant", "b.", 2, "v")],
                                 T.StructType.fromDDL("conv_id string, turn int, role string, text string, seq int, kind string"))
    out = R.report(R.repair(rows)).collect()
    assert [(r["conv_id"], r["audit"], r["cost"]) for r in out] == [("x", "KK", 0)]
