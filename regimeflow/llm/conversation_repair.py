"""Conversation structure repair: the cheapest edits that make the turns alternate, by a Viterbi search over survivors.

A conversation's rows, in the order of their turns, are kept, given another role, or deleted, and empty rows are inserted,
so that the roles read ``(s?(ua)+)?`` by their initials.  Four states say how far the pattern has come.  Row by row the
cheapest way into each state survives; ways are nodes of a backpointer tree.  A node counts the children that survive
and falls away with the last; as soon as all survivors share an ancestor, the edits up to it are settled and emitted, so
the tree holds the unresolved suffixes only.  Equal costs are decided by comparing the complete suffixes since the last
common ancestor.  A survivor goes early when another state, plus what it costs at most to stand in for it, is cheaper.

Conversations may be of any length.  Rows are numbered in one global order and dealt to tasks in blocks of ``BLOCK``
numbers, with the neighbouring rows of both sides as a halo.  What lies inside a block is solved there.  A
conversation that crosses an edge becomes, per block, a table from state to state (cost, and the order of the ways);
the same search over those tables, block after block, fixes the states at the edges, and each block is then solved
between them.  Equal rows are one row with a count from the start: its copies are duplicates whatever their number.

Edge cases: null roles and texts count as one space, null conversation ids are one conversation, null turns come first;
rows of one turn go by role and text.  Empty tables give no rows; a conversation without rows has no edits.  Very long
texts are never in a search, only hashed.  Extra columns are ignored.

The report hashes each repaired conversation as a stream in one task, in constant memory: SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeflow.llm.common import ASCII_SPACE, consecutive, save, text_key
from regimeflow.operators.ordering import partition_offsets, with_offset

# Costs of the edits, the pattern's states, and what follows on what.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ANSWER = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ANSWER}, ANSWER: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
# STAND_IN[x][y]: the rest from state x costs at most so much more than the rest from state y.
STAND_IN = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
BLOCK, HEAD = 65_536, 64
Move = tuple[int, int, int, str, str]  # from, to, cost, edits, rows written


def _wanted(state: int) -> str:
    return "a" if state == USER else "u"


def moves_for(kind: str, initial: str) -> list[Move]:
    """The best way from state to state over one row: ``D`` must go, ``T`` is truncated, ``K`` is sound.

    In the rows written u and a are inserted ones, U and A the row with another role, K the row itself.  Rows are only
    inserted in front of one that stays (or at the end): deletions sort before insertions.
    """
    best: dict[tuple[int, int], Move] = {}

    def offer(*move) -> None:
        old = best.get(move[:2])
        if old is None or move[2:4] < old[2:4]:
            best[move[:2]] = move

    for start in FOLLOWS:
        offer(start, start, DELETE, "D", "")
        state, written = start, ""
        for inserted in range(3 if kind != "D" else 0):
            base = INSERT * inserted + (TRUNCATED if kind == "T" else 0)
            if initial in FOLLOWS[state]:
                offer(start, FOLLOWS[state][initial], base, "I" * inserted + "K", written + "K")
            role = _wanted(state)
            offer(start, FOLLOWS[state][role], base + RENAME, "I" * inserted + "R", written + role.upper())
            state, written = FOLLOWS[state][role], written + role
    return sorted(best.values())


def closing(state: int) -> tuple[int, str, str]:
    """(cost, edits, rows written) to end well from a state."""
    written = ""
    while state not in (START, ANSWER):
        written, state = written + _wanted(state), FOLLOWS[state][_wanted(state)]
    return INSERT * len(written), "I" * len(written), written


MOVES = {(kind, initial): moves_for(kind, initial) for kind in "DTK" for initial in ("s", "u", "a", "")}


class _Node:
    __slots__ = ("parent", "label", "payload", "children")

    def __init__(self, parent, label, payload):
        self.parent, self.label, self.payload, self.children = parent, label, payload, []


class Survivors:
    """The backpointer tree over one sequence of rows (or of blocks)."""

    def __init__(self, entry: int = START, prune: bool = True):
        self.root = _Node(None, "", None)
        self.live, self.prune = {entry: (0, self.root)}, prune

    def _before(self, a: _Node, a_label: str, b: _Node, b_label: str) -> bool:
        """Whether the way over ``a`` sorts before the one over ``b``: the complete suffixes since they parted."""
        left, right = [a_label], [b_label]
        while a is not b:
            left.append(a.label)
            right.append(b.label)
            a, b = a.parent, b.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def step(self, moves: list, payload) -> list:
        """Takes every survivor over a row; what became settled: (payload of the row, move) in order."""
        new: dict[int, tuple] = {}
        for move in moves:
            if move[0] not in self.live:
                continue
            cost, node = self.live[move[0]]
            cost, old = cost + move[2], new.get(move[1])
            if old is None or cost < old[0] or cost == old[0] and self._before(node, move[3], old[1], old[2][3]):
                new[move[1]] = (cost, node, move)
        if self.prune:
            new = {y: n for y, n in new.items() if all(x[0] + STAND_IN[s][y] >= n[0] for s, x in new.items())}
        before, self.live = self.live, {}
        for state, (cost, parent, move) in new.items():
            node = _Node(parent, move[3], (payload, move))
            parent.children.append(node)
            self.live[state] = (cost, node)
        for _, node in before.values():
            while not node.children and node is not self.root:
                node.parent.children.remove(node)
                node = node.parent
        settled = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            settled.append(self.root.payload)
        return settled

    def finish(self, exit_state: int | None = None) -> list:
        """The rest, ending in the given state, or else wherever the end costs least."""
        if exit_state is None:
            exit_state, way = None, None
            for state, (cost, node) in self.live.items():
                extra, edits, _ = closing(state)
                if way is None or cost + extra < way[0] or cost + extra == way[0] and self._before(node, edits, way[1], way[2]):
                    exit_state, way = state, (cost + extra, node, edits)
        self.exit, node, rest = exit_state, self.live[exit_state][1], []
        while node is not self.root:
            rest.append(node.payload)
            node = node.parent
        return rest[::-1]

    def ranked(self) -> dict[int, tuple[int, int]]:
        """State: (cost, place of its way in the order of edits)."""
        from functools import cmp_to_key

        states = sorted(self.live, key=cmp_to_key(lambda a, b: -1 if self._before(self.live[a][1], "", self.live[b][1], "") else 1))
        return {s: (self.live[s][0], i) for i, s in enumerate(states)}


def row_moves(kind: str, initial: str, copies: int) -> list[Move]:
    """Of a row and its copies, which are deleted."""
    moves = MOVES[kind, initial if initial in ("s", "u", "a") else ""]
    return moves if copies == 1 else [(s, t, c + DELETE * (copies - 1), e + "D" * (copies - 1), w) for s, t, c, e, w in moves]


def solve(rows: list[tuple], entry: int = START, exit_state: int | None = None, ends: bool = True) -> Iterator[tuple]:
    """(payload, edits, rows written, cost) for rows ``(payload, kind, initial, copies)`` between two states.

    Without ``exit_state`` the end is free; ``ends`` adds what closes the pattern to the last row.
    """
    search, held = Survivors(entry, prune=exit_state is None), None
    for payload, kind, initial, copies in rows:
        for done in search.step(row_moves(kind, initial, copies), payload):
            if held:
                yield held
            held = (done[0], done[1][3], done[1][4], done[1][2])
    for done in search.finish(exit_state):
        if held:
            yield held
        held = (done[0], done[1][3], done[1][4], done[1][2])
    if held:
        cost, edits, written = closing(search.exit) if ends else (0, "", "")
        yield held[0], held[1] + edits, held[2] + written, held[3] + cost


def state_map(rows: list[tuple]) -> list[Move]:
    """From state to state over all rows: (from, to, cost, place in the order of ways as a letter, "")."""
    out = []
    for entry in FOLLOWS:
        search = Survivors(entry, prune=False)
        for payload, kind, initial, copies in rows:
            search.step(row_moves(kind, initial, copies), payload)
        out += [(entry, state, cost, str(place), "") for state, (cost, place) in search.ranked().items()]
    return out


# ---------------------------------------------------------------------------------------------------- Spark side

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults planted by the checksum of ``conv_id:turn`` modulo 20."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(named) % 20).alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where(F.col("_fault") != 0).withColumn("_copy", F.explode(times))
    return out.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, fault and place: seq, unnamed, conv, turn, role, text, copies, kind, initial, blank, duplicate, truncated."""
    keyed = rows.select(
        F.col("conv_id").isNull().alias("unnamed"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").isNotNull().alias("placed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    h1, h2 = text_key(F.struct("role", "text"))
    keys = ["unnamed", "conv", "h1", "h2"]
    once = keyed.withColumns({"h1": h1, "h2": h2}).groupBy(*keys, "placed", "at").agg(
        F.any_value("role").alias("role"), F.any_value("text").alias("text"), F.count("*").alias("copies"))
    first = keyed.select("unnamed", "conv", "placed", "at", h1.alias("h1"), h2.alias("h2")).groupBy(*keys).agg(F.min(F.struct("placed", "at")).alias("f"))
    first = first.select(*keys, "f.placed", "f.at", F.lit(True).alias("is_first"))
    stripped = F.btrim("text", F.lit(ASCII_SPACE))
    blank, seen = stripped == "", F.col("is_first").isNull()
    cut = ~F.substring(stripped, -1, 1).isin(".", "!", "?")
    marked = once.join(first, [*keys, "placed", "at"], "left").select(
        "unnamed", "conv", "placed", "at", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"),
        F.when(blank | seen, "D").when(cut, "T").otherwise("K").alias("kind"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).when(seen, F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        F.when(~blank & ~seen & cut, 1).otherwise(0).cast("long").alias("truncated"))
    order = ["unnamed", "conv", "placed", "at", "role"]
    placed = marked.repartitionByRange(*order, F.substring("text", 1, HEAD)).sortWithinPartitions(*order, "text")
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    table = save(placed, "turns")
    offsets, _ = partition_offsets(table, n=F.count("*"))["n"]
    return with_offset(table, offsets, "offset").withColumn("seq", F.col("offset") + F.col("pos")).drop("part", "pos", "offset")


ROW = "seq long, unnamed boolean, conv string, block long, kind string, initial string, copies long, illegal long"
FIRST_PASS = f"{ROW}, cost long, edits string, written string, ways array<struct<a: int, b: int, cost: bigint, place: string>>"


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _input(rows: list[dict]) -> list[tuple]:
    return [(r, r["kind"], r["initial"], r["copies"]) for r in rows]


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (rows[i]["unnamed"], rows[i]["conv"]) != (rows[start]["unnamed"], rows[start]["conv"]):
            yield rows[start:i]
            start = i


def _block_edits(batches: Iterator[pa.RecordBatch], block_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (block,), table in consecutive(batches, ["block"]):
        rows = _rows(table)
        out: list[dict] = []
        for run in _runs(rows):
            inside = [r for r in run if r["seq"] // block_rows == block]
            for i, r in enumerate(run):
                broken = i > 0 and run[i - 1]["initial"] + r["initial"] not in LEGAL_PAIRS
                r["illegal"] = r["copies"] - 1 + broken
            if len(inside) == len(run):
                out += [{**r, "cost": cost, "edits": edits, "written": written} for r, edits, written, cost in solve(_input(run))]
            elif inside:
                out += inside
                ways = [{"a": a, "b": b, "cost": c, "place": p} for a, b, c, p, _ in state_map(_input(inside))]
                out.append({"unnamed": run[0]["unnamed"], "conv": run[0]["conv"], "block": block, "ways": ways})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _edge_states(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The search over the blocks of each conversation: (block, entry, exit, whether it is the last)."""
    for (unnamed, conv), group in _streams(batches, ["unnamed", "conv"]):
        search, held = Survivors(), None
        for done in _settled(search, group):
            if held:
                yield pa.RecordBatch.from_pylist([held], schema)
            block, (entry, exit_state, *_) = done
            held = {"unnamed": unnamed, "conv": conv, "block": block, "entry": entry, "exit": exit_state, "ends": False}
        if held:
            yield pa.RecordBatch.from_pylist([{**held, "ends": True}], schema)


def _settled(search: Survivors, rows: Iterator[dict]) -> Iterator[tuple]:
    for r in rows:
        yield from search.step([(w["a"], w["b"], w["cost"], w["place"], "") for w in r["ways"]], r["block"])
    yield from search.finish()


def _streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal keys as a stream; never a group as a whole."""
    from itertools import groupby

    rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _arrow(df_schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], df_schema).schema)


def edits(marked: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """seq, illegal, cost, edits and rows written of every row."""
    spark = marked.sparkSession
    own = F.floor(F.col("seq") / block_rows).cast("long")
    halo = F.array_compact(F.array(own, F.when(F.col("seq") % block_rows == block_rows - 1, own + 1),
                                   F.when((F.col("seq") % block_rows == 0) & (own > 0), own - 1)))
    narrow = marked.select("seq", "unnamed", "conv", F.explode(halo).alias("block"), "kind", "initial", "copies", F.lit(0).cast("long").alias("illegal"))
    first_schema = _arrow(FIRST_PASS, spark)
    first = narrow.repartition("block").sortWithinPartitions("block", "seq").mapInArrow(lambda b: _block_edits(b, block_rows, first_schema), FIRST_PASS)
    first = save(first, "turn-edits")
    solved = ["seq", "illegal", "cost", "edits", "written"]
    edge = "unnamed boolean, conv string, block long, entry int, exit int, ends boolean"
    edge_schema = _arrow(edge, spark)
    maps = first.where(F.col("ways").isNotNull()).select("unnamed", "conv", "block", "ways")
    states = maps.repartition("unnamed", "conv").sortWithinPartitions("unnamed", "conv", "block").mapInArrow(lambda b: _edge_states(b, edge_schema), edge)
    open_ = first.where(F.col("ways").isNull() & F.col("edits").isNull()).drop("ways", "cost", "edits", "written")
    between = open_.join(states, ["unnamed", "conv", "block"]).repartition("block").sortWithinPartitions("block", "seq")
    second = "seq long, illegal long, cost long, edits string, written string"
    second_schema = _arrow(second, spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in consecutive(batches, ["block"]):
            out: list[dict] = []
            for run in _runs(_rows(table)):
                plan = run[0]
                for r, e, w, c in solve(_input(run), plan["entry"], plan["exit"], plan["ends"]):
                    out.append({"seq": r["seq"], "illegal": r["illegal"], "cost": c, "edits": e, "written": w})
            yield pa.RecordBatch.from_pylist(out, second_schema)

    return first.where(F.col("edits").isNotNull()).select(*solved).unionByName(between.mapInArrow(finish, second))


def written_rows(written: Column) -> Column:
    """The rows that stand for one row in the repaired conversation, as ``role`` and ``text``."""
    def row(letter: Column) -> Column:
        role = F.when(F.lower(letter) == "u", ROLES["u"]).when(F.lower(letter) == "a", ROLES["a"]).otherwise(F.col("role"))
        text = F.when(letter.isin("u", "a"), "").otherwise(F.col("text"))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.filter(F.split(written, ""), lambda c: c != ""), row)


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """A row per distinct row of ``rows`` (conv_id, turn, role, text): its place and faults, the edits made to it, their
    cost, and the repaired rows in its place."""
    kind = rows.schema["conv_id"].dataType
    marked = faulty_rows(rows)
    done = marked.join(edits(marked, block_rows), "seq")
    return done.select(
        F.when(~F.col("unnamed"), F.col("conv")).cast(kind).alias("conv_id"), F.when(F.col("placed"), F.col("at")).alias("turn"), "seq", "copies",
        "blank", "duplicate", "truncated", "illegal", "cost", "edits", written_rows(F.col("written")).alias("repaired"))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(repaired: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal pairs, cost, the edits as one text (audit) and the hash of what is left."""
    schema_text = ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"
    spark, kind = repaired.sparkSession, repaired.schema["conv_id"].dataType
    schema_text = f"unnamed boolean, conv string, {schema_text}"
    schema = _arrow(schema_text, spark)
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    rows = repaired.select(
        F.col("conv_id").isNull().alias("unnamed"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "seq", "turn",
        *REPORT[1:], "edits", F.when(F.size("repaired") > 0, lines).alias("lines"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (unnamed, conv), group in _streams(batches, ["unnamed", "conv"]):
            sums, audit, sha = dict.fromkeys(REPORT[1:], 0), [], hashlib.sha256()
            low = high = None
            turns, begun = 0, False
            for r in group:
                for c in sums:
                    sums[c] += r[c]
                audit.append(r["edits"])
                if r["turn"] is not None and r["turn"] != high:
                    low, high, turns = r["turn"] if low is None else low, r["turn"], turns + 1
                if r["lines"] is not None:
                    sha.update(("\n" if begun else "").encode() + r["lines"].encode("utf-8", "surrogatepass"))
                    begun = True
            gaps = 0 if low is None else high - low + 1 - turns
            yield pa.RecordBatch.from_pylist([{"unnamed": unnamed, "conv": conv, "gaps": gaps, **sums, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    out = rows.repartition("unnamed", "conv").sortWithinPartitions("unnamed", "conv", "seq").mapInArrow(digest, schema_text)
    return out.select(F.when(~F.col("unnamed"), F.col("conv")).cast(kind).alias("conv_id"), *REPORT, "audit", "repaired_sha256")


def with_empty(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every conversation id, with zeros and the hash of nothing where no row is left."""
    every = conversations.select("conv_id").distinct()
    same = every["conv_id"].eqNullSafe(found["conv_id"])
    zeros = [F.coalesce(found[c], F.lit(0)).cast("long").alias(c) for c in REPORT]
    return every.join(found, same, "left").select(
        every["conv_id"], *zeros, F.coalesce(found["audit"], F.lit("")).alias("audit"),
        F.coalesce(found["repaired_sha256"], F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
