"""N-gram Jaccard join by a prefix tree over globally ordered sets.

Every document is the sorted set of its shingle hashes; the order of the hashes is the global order, the sorted set a
path in one large prefix tree.  The tree is dealt to tasks by ranges of the order.  Two sets linked at the
threshold differ in at most ``d`` shingles (``d`` follows from the sizes), so cut into more than ``d`` ranges they agree
on a whole range: the *pieces* of their paths there are equal.  Shingles that a sample shows to be frequent stand last
in the order, in a range of their own that is not used.  There are some ranges more than that, so linked sets agree
on several pieces, say s; a set can do without the s - 1 of its pieces that most sets share, since the rarest one that both
hold has s - 1 others behind it in either set.  Equal pieces (and size class) among the rest bring documents
together; the least node of such a meeting leads it.  Each leader's meeting is a prefix tree of the members' sets,
which the leader's set descends: overlap counted on a shared edge holds for everything below it, and a subtree is left
as soon as the shingles that remain on either side cannot reach the threshold.  Members without a link to the leader are
held against the whole meeting, too: an index of its shingles counts what each member shares with one of them, and the tree of
those that share enough is descended, except where they are connected already.  So no link between
different texts is lost, and copies are never expanded into pairs.

Equal sets are one node from the start, numbered by Spark.  Meetings are worked through in parts of at most ``PART`` members.

Edge cases: texts without words (null, empty) have an empty set and link with nothing; with fewer words than the shingle
width the whole sequence is one shingle.  Every row is a document: rows that repeat a doc_id with another text link for
themselves, each with the least doc_id that its own text reaches; rows without one are their own component (null).  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regimeflow.llm.common import save, text_or_empty
from regimeflow.llm.components import components
from regimeflow.llm.shingles import mix, shingles

WIDTH, PERCENT, PART, BATCH_BYTES, SLICE = 3, 90, 2048, 1 << 20, 64
CLASS_RATIO, MOST_SPARE = 1.5, 255  # sizes per class; pieces that a list can do without are counted so far
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 16_384, 4, 200_000
_NONE = np.zeros(0, np.uint64)


@lru_cache(maxsize=8)
def _classes(percent: int) -> list[tuple[int, int, int, int]]:
    """Per class of the smaller set: least size, largest size of it and of its partner, possible differences."""
    out, low = [], 1
    while low < 1 << 40:
        top = max(low, int(low * CLASS_RATIO) - 1)
        partner = top * 100 // percent
        out.append((low, top, partner, (top + partner) * (100 - percent) // (100 + percent)))
        low = top + 1
    return out


def _spare(differ: int) -> int:
    """Ranges beyond the possible differences: more than are empty by chance, so that empty ones need no key."""
    return 2 + differ // 6


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _cut(ordered: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the contents of m ranges of the order, and which ranges are empty."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ordered ^ np.uint64(0x5DEECE66D)))))
    edges = np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)
    cut = np.concatenate(([0], np.searchsorted(ordered, edges), [len(ordered)]))
    return sums[cut[1:]] - sums[cut[:-1]], cut[1:] == cut[:-1]


def pieces(ordered: np.ndarray, percent: int, frequent: np.ndarray = _NONE) -> np.ndarray:
    """Keys of the pieces of a sorted set, for every class in which it can have a partner."""
    return pieces_and_spares(ordered, percent, frequent)[0]


def pieces_and_spares(ordered: np.ndarray, percent: int, frequent: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces of a sorted set, and for each the number of its list and how many pieces the list can do without.

    A list has the pieces of one class and content.  Of the ranges in which linked sets agree, as many are not empty as
    ``_spare`` has more than there are empty ones in either set; so many keys they share at least, one can be left to bring them together.

    Linked sets agree on at least ``_spare`` of the ranges.  Frequent shingles are left out first; unless as many ranges
    are empty then, an agreeing one has shingles in it and its key is shared.  Sets with that many empty ranges give
    the keys of their whole content, too, empty ranges included only where again there are so many.
    """
    n, out, spares = len(ordered), [], []
    rare = ordered
    if len(frequent) and n:
        rare = ordered[frequent[np.minimum(np.searchsorted(frequent, ordered), len(frequent) - 1)] != ordered]
    for k, (low, top, partner, differ) in enumerate(_classes(percent)):
        if low > n:
            break
        if not differ or not (n <= top or n <= partner):
            continue
        spare = _spare(differ)
        m = differ + spare
        for way, content in enumerate((rare, ordered)):
            key, empty = _cut(content, m)
            many = empty.sum() >= spare
            use = np.arange(m) if many and way else np.flatnonzero(~empty)
            without = 0 if many else min(spare - int(empty.sum()) - 1, MOST_SPARE)
            spares.append(np.full(len(use), (2 * k + way) * (MOST_SPARE + 1) + without, np.int32))
            out.append(mix(key[use] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * k + way) << 40) + use.astype(np.uint64)))
            if not many:
                break
    return (np.concatenate(out), np.concatenate(spares)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _batches(keys: pa.Array, texts: pa.Array, limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and encoded texts of a column in slices of about ``limit`` bytes; only one slice is decoded at a time."""
    held_keys, held, size = [], [], 0
    for at in range(0, len(texts), SLICE):
        for k, t in zip(keys.slice(at, SLICE).to_pylist(), texts.slice(at, SLICE).to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            if held and size + len(raw) > limit:
                yield held_keys, held
                held_keys, held, size = [], [], 0
            held_keys.append(k)
            held.append(raw)
            size += len(raw)
    if held:
        yield held_keys, held


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    flat, at = shingles(texts, width)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def frequent_shingles(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """Shingles of at least ``FREQUENT`` among about ``SAMPLE_DOCS`` documents drawn by hash, at most ``MAX_FREQUENT``, sorted.

    They make up the last stretch of the global order, which names no meetings, since documents share them by the
    hundreds without being alike.  Any such set gives the same links; a better one saves work.
    """
    share = int(min(1.0, SAMPLE_DOCS / max(docs.count(), 1)) * (1 << 20)) + 1
    body = text_or_empty(text)
    some = docs.where(F.pmod(F.xxhash64(F.lit("shingles"), body), F.lit(1 << 20)) < share).select(F.lit(0).alias("key"), body.alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch.column(0), batch.column(1), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s.view(np.int64) for s in sets_of(texts, width)]))], ["shingle"])

    counted = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counted.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).collect()
    return np.sort(np.array([r["shingle"] for r in found], np.int64).view(np.uint64))


def described(docs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """doc_id, hash of the text, set size, 128-bit key of the set, keys of its pieces with the numbers of ``pieces_and_spares``."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width, text))  # at most MAX_FREQUENT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(2)], ["doc", "text_hash"])
            for keys, texts in _batches(pairs, batch.column(1), BATCH_BYTES):
                sets = sets_of(texts, width)
                whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                key_at = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
                found, spares = zip(*(pieces_and_spares(s, percent, held.value) for s in sets), strict=True)
                at = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in found]))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *pa.array(keys, pairs.type).flatten(), pa.array([len(s) for s in sets], pa.int64()), pa.array(key_at[:, 0]), pa.array(key_at[:, 1]),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(found).view(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(spares)))],
                    ["doc", "text_hash", "n", "h1", "h2", "pieces", "spares"])

    body = text_or_empty(text)
    rows = docs.select(F.col(key).cast("long").alias("doc"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    return rows.mapInArrow(run, "doc long, text_hash long, n long, h1 long, h2 long, pieces array<long>, spares array<int>")


# ------------------------------------------------------------------------------------------------------ the prefix tree

class PrefixTree:
    """Sorted sets as a radix tree: a node is a run of the lexicographically ordered sets and the depth they share."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.index, self.sets = order, [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.nodes: dict[tuple[int, int, int], tuple[int, list[tuple[int, int]]]] = {}

    def _node(self, low: int, high: int, depth: int) -> tuple[int, list[tuple[int, int]]]:
        """Depth that all sets of the run share, and the runs below it."""
        known = self.nodes.get((low, high, depth))
        if known is None:
            a, b = self.sets[low], self.sets[high - 1]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            shared = depth + int(differ[0]) if len(differ) else n
            runs, at = [], low
            while at < high:
                end = at + 1
                head = self.sets[at][shared] if len(self.sets[at]) > shared else None
                while end < high and head is not None and self.sets[end][shared] == head:
                    end += 1
                runs.append((at, end))
                at = end
            known = self.nodes[low, high, depth] = (shared, runs)
        return known

    def search(self, one: np.ndarray, percent: int, skip=None) -> list[int]:
        """Indexes of the sets linked with ``one``; ``skip(i)`` leaves out sets whose answer is not needed."""
        out, n = [], len(one)
        stack = [(0, len(self.sets), 0, 0, 0)] if self.sets else []
        while stack:
            low, high, depth, at, both = stack.pop()
            if skip is not None and all(skip(self.index[i]) for i in range(low, high)):
                continue
            single = high - low == 1
            shared, runs = (len(self.sets[low]), []) if single else self._node(low, high, depth)
            edge = self.sets[low][depth:shared]
            if len(edge):
                place = np.searchsorted(one, edge)
                both += int((one[np.minimum(place, n - 1)] == edge).sum())
                at = int(np.searchsorted(one, edge[-1], side="right"))
            if single:
                if linked(n, shared, both, percent):
                    out.append(self.index[low])
                continue
            sizes = self.sizes[low:high]
            reach = both + min(n - at, int(sizes.max()) - shared)  # the remaining lengths bound every overlap below
            if 100 * reach < percent * (n + int(sizes.min()) - reach):
                continue
            stack.extend((a, b, shared, at, both) for a, b in runs)
        return out


class Overlaps:
    """How much of a set each of many sets holds: their elements in order, and the set of each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        held = np.concatenate([*sets, _NONE])
        order = np.argsort(held, kind="stable")
        self.values, first = np.unique(held[order], return_index=True)
        self.at = np.append(first, len(held))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, one: np.ndarray, percent: int) -> list[int]:
        """Indexes of the sets as similar to ``one`` as asked for; a path of the tree is walked only where it ends in one of them."""
        if not len(self.values):
            return []
        place = np.minimum(np.searchsorted(self.values, one), len(self.values) - 1)
        place = place[self.values[place] == one]
        begin, count = self.at[place], self.at[place + 1] - self.at[place]
        owner = self.owner[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        both = np.bincount(owner, minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(one) + self.sizes - both)).tolist()


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows sorted by ``by``, also where a group goes on in the next frame."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        change = np.flatnonzero((frame[by].iloc[1:].to_numpy() != frame[by].iloc[:-1].to_numpy()).any(axis=1)) + 1
        cut = [0, *change.tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[cut[-1]:]
    if rest is not None and len(rest):
        yield rest


def _texts_of(meetings: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """node and text of every node that meets another; the one time that texts are shuffled."""
    involved = meetings.select("node").union(meetings.select(F.col("leader"))).distinct()
    wanted = nodes.select("node", "doc", "text_hash").join(involved, "node", "left_semi").distinct()
    body = text_or_empty(text)
    once = docs.select(F.col(key).cast("long").alias("doc"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    return save(once.join(wanted.hint("merge"), ["doc", "text_hash"]).select("node", "text"), "met-texts")


def _against_leader(meetings: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """leader, node, linked."""
    size = meetings.groupBy("leader").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    member = meetings.join(size, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    leader = size.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    rows = member.union(leader).join(texts, "node").repartition("leader", "part").sortWithinPartitions("leader", "part", "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(frames, ["leader", "part"]):
            g = g.drop_duplicates("node")
            nodes, sets = g["node"].to_numpy(), sets_of([t.encode("utf-8", "surrogatepass") for t in g["text"]], width)
            lead = int(g["leader"].iloc[0])
            at = int(np.flatnonzero(nodes == lead)[0])
            others = [i for i in range(len(sets)) if i != at]
            found = set(PrefixTree([sets[i] for i in others]).search(sets[at], percent))
            yield pd.DataFrame({"leader": lead, "node": nodes[others], "linked": [i in found for i in range(len(others))]})

    return rows.select("leader", "part", "node", "text").mapInPandas(run, "leader long, node long, linked boolean")


def _among_members(tested: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) of members that have none with their leader, to members of the same meeting in other components."""
    comp = components(tested.where("linked"), "leader", "node")
    loose = tested.where(~F.col("linked")).select("leader", "node")
    open_ = loose.groupBy("leader").agg(F.ceil(F.count("*") / PART).cast("long").alias("a_parts"))
    whole = tested.join(open_, "leader").groupBy("leader", "a_parts").agg(F.ceil(F.count("*") / PART).cast("long").alias("b_parts"))

    def numbers(c):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def part(c):
        return F.pmod(F.xxhash64("node"), F.col(c))

    asks = loose.join(whole, "leader").select("leader", part("a_parts").alias("a"), numbers("b_parts").alias("b"), "node", F.lit(True).alias("asks"))
    told = tested.select("leader", "node").join(whole, "leader").select("leader", numbers("a_parts").alias("a"), part("b_parts").alias("b"), "node", F.lit(False).alias("asks"))
    labelled = asks.union(told).join(comp.select("node", "component"), "node", "left")
    by = ["leader", "a", "b"]
    rows = labelled.join(texts, "node").repartition(*by).sortWithinPartitions(*by, "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(frames, by):
            first = g.drop_duplicates("node")
            sets = dict(zip(first["node"], sets_of([t.encode("utf-8", "surrogatepass") for t in first["text"]], width), strict=True))
            comp_of = {n: n if c is None or c != c else int(c) for n, c in zip(first["node"], first["component"], strict=True)}
            up = {}

            def root(x):
                while x in up:
                    x = up[x]
                return x

            told = g[~g["asks"]]["node"].unique().tolist()
            overlaps = Overlaps([sets[n] for n in told])
            links = []
            for n in g[g["asks"]]["node"].unique().tolist():
                near = [i for i in overlaps.near(sets[n], percent) if told[i] != n and root(comp_of[told[i]]) != root(comp_of[n])]
                tree = PrefixTree([sets[told[i]] for i in near])
                for i in tree.search(sets[n], percent, lambda i: root(comp_of[told[near[i]]]) == root(comp_of[n])):
                    other, mine = root(comp_of[told[near[i]]]), root(comp_of[n])
                    if other != mine:
                        up[max(mine, other)] = min(mine, other)
                        links.append((n, told[near[i]]))
            if links:
                yield pd.DataFrame(links, columns=["u", "v"])

    return rows.select(*by, "node", "text", "component", "asks").mapInPandas(run, "u long, v long")


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, text_hash (of the text, by which rows of one doc are told apart), n, group, component of every row.

    ``group`` is a number shared by the rows that links connect (null: empty set or no doc), ``component`` their least doc.
    """
    rows = save(described(docs, width, percent, text, key), "sets")
    known = rows.where((F.col("n") > 0) & F.col("doc").isNotNull())
    # numbers need only be distinct; written, so that every later pass reads the same ones
    first = save(known.groupBy("h1", "h2").agg(F.min("doc").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "numbers")

    def of_least(*columns):
        """node and columns of the rows that stand for it."""
        same = (F.col("k.h1") == F.col("f.h1")) & (F.col("k.h2") == F.col("f.h2")) & (F.col("doc") == F.col("rep"))
        return known.alias("k").join(first.alias("f"), same).select("node", *columns)

    nodes = save(of_least("doc", "text_hash"), "nodes")
    # pieces, most of the bytes here, are shuffled once; those of one set alone go at once
    each = of_least(F.explode(F.arrays_zip("pieces", "spares")).alias("p")).select("node", F.col("p.pieces").alias("piece"), F.col("p.spares").alias("spare"))
    shared = save(each.withColumn("held", F.count("*").over(Window.partitionBy("piece"))).where("held > 1"), "shared-pieces")
    # a set's most frequent pieces, as many as its list can do without, name no meetings
    nth = F.row_number().over(Window.partitionBy("node", "spare").orderBy(F.desc("held"), "piece"))
    rarest = shared.withColumn("nth", nth).where(F.col("nth") > F.col("spare") % (MOST_SPARE + 1)).select("node", "piece")
    # in order, each row of a piece sees the least node before it
    in_order = Window.partitionBy("piece").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    met = rarest.withColumn("leader", F.first("node").over(in_order))
    meetings = save(met.where(F.col("node") != F.col("leader")).select("leader", "node").distinct(), "meetings")
    texts = _texts_of(meetings, nodes, docs, text, key)
    tested = save(_against_leader(meetings, texts, width, percent), "tested")
    more = _among_members(tested, texts, width, percent)
    links = tested.where("linked").select(F.col("leader").alias("u"), F.col("node").alias("v")).union(more)
    comp = components(links, "u", "v").withColumnRenamed("component", "group")
    comp = comp.union(comp.select("group", "group").distinct())  # the least node stands only in the other column
    least = comp.join(first, "node").groupBy("group").agg(F.min("rep").alias("component"))
    linked_ = comp.join(least, "group")
    named = first.join(linked_, "node", "left").select("h1", "h2", F.coalesce("group", "node").alias("group"), F.coalesce("component", "rep").alias("component"))
    found = rows.select("doc", "text_hash", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = (F.col("n") > 0) & F.col("doc").isNotNull()
    return found.select("doc", "text_hash", "n", F.when(own, F.col("group")).alias("group"), F.when(own, F.col("component")).otherwise(F.col("doc")).alias("component"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (least document reachable by links) of every row."""
    found = jaccard_groups(docs, width, percent, text, key)
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
