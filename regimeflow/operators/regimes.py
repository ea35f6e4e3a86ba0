"""Regimes: k-means over latent states, silhouette, and the choice of K."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimeflow.functions.vectors import distance_weights, distances_to, nearest_index, normalised
from regimeflow.operators.chunks import matrix, vectors
from regimeflow.operators.sampling import sample_key
from regimeflow.scratch import materialize

# Iteration cap, convergence threshold, softmax temperature, and the bounds of the K search.
MAX_ITER, SHIFT_TOL, TEMPERATURE = 200, 1e-7, 3.0
K_MIN, K_MAX, MAX_CLUSTERS = 2, 10, 1_000
DEFAULT_REGIMES = 3

MERGE_TASKS, MERGE_COLUMNS = 256, 2_000
# Lloyd steps over undecided rows: how many steps' movement is reckoned with, when it is worth a pass to find them, and
# how many must be decided; the lead that covers rounding.
REACH, NEAR, SHRINK, RETRY, NARROW_ROWS, MOSTLY, LEAD_EPS = 16.0, 0.1, 4.0, 1.5, 50_000, 0.5, 1e-9
BLOCK_ROWS, SLICE_ROWS = 1 << 16, 1 << 13  # vectors stored together where every step reads them; vectors worked on at a time
ANCHOR_CELLS, ANCHOR_SUMS = 1 << 20, 1 << 20  # distances formed at once; sums that a task adds up


def initial_centroids(df: DataFrame, k: int, keys: list[str], vec: str = "z", seed: int = 42) -> np.ndarray:
    """K distinct rows, the ones with the smallest seeded hash."""
    rows = df.select(vec, *keys).orderBy(sample_key(seed, *keys), *keys).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} regimes need at least {k} rows")
    return np.array([r[vec] for r in rows], dtype=np.float64)


def squared_distances(z: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Row by point, one dimension at a time.  Differences are formed first: exact ties must stay ties."""
    total = np.zeros((len(z), len(points)))
    for j in range(points.shape[1]):
        total += (z[:, j, None] - points[:, j]) ** 2
    return total


def packed(df: DataFrame, vec: str = "z") -> DataFrame:
    """The vectors alone, ``BLOCK_ROWS`` to a row as the bytes of their doubles: a pass moves blocks, not lists.

    A null list, a null in a list or lists of different lengths raise, as in :func:`matrix`.
    """
    return df.select(vec).mapInArrow(lambda batches: _blocks(matrix(b.column(0)).astype(np.float64) for b in batches if b.num_rows), f"`{vec}` binary")


def _blocks(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for z in parts:
        held.append(z)
        rows += len(z)
        if rows >= BLOCK_ROWS:
            yield _one_block(held)
            held, rows = [], 0
    if rows:
        yield _one_block(held)


def _one_block(held: list[np.ndarray]) -> pa.RecordBatch:
    if len({z.shape[1] for z in held}) > 1:
        raise ValueError("vectors must be without nulls and of one length")
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["z"])


def _parts(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    """The vectors of a batch, of a list column or of :func:`packed` blocks."""
    values = batch.column(0)
    if not pa.types.is_binary(values.type):
        yield matrix(values).astype(np.float64)
        return
    for block in values:
        z = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, dims)
        for at in range(0, len(z), SLICE_ROWS):
            yield z[at:at + SLICE_ROWS]


def _added_up(df: DataFrame, columns: list[str], measure, size: int, tasks: int | None = None) -> np.ndarray:
    """Sum over all rows of ``measure(batch)``, ``size`` numbers.

    Tasks add up their rows first, so one row per task is left to merge: on the driver when there are few tasks,
    by a shuffle otherwise.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                sums += measure(batch)
        yield pa.RecordBatch.from_arrays([vectors(sums.reshape(1, -1))], ["sums"])

    partials = df.select(*columns).mapInArrow(partial, "sums array<double>")
    many = (tasks or df.rdd.getNumPartitions()) > MERGE_TASKS
    if many and size > MERGE_COLUMNS:  # too many for an aggregate each: a row per place
        total = np.zeros(size)
        for place, value in partials.select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("v")).collect():
            total[place] = value
        return total
    if many:
        partials = partials.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    rows = [r["sums"] for r in partials.collect() if r["sums"] is not None]
    return np.sum(rows, axis=0) if rows else np.zeros(size)


def _regime_sums(df: DataFrame, centres: list[np.ndarray], vec: str, tasks: int | None = None) -> list[np.ndarray]:
    """Per clustering a row per regime: totals per dimension, then the size.  One pass serves all."""
    dims = centres[0].shape[1]
    ends = np.cumsum([len(c) * (dims + 1) for c in centres])

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        return sum(_sums_of(z, centres) for z in _parts(batch, dims))

    merged = _added_up(df, [vec], measure, int(ends[-1]), tasks)
    return [part.reshape(-1, dims + 1) for part in np.split(merged, ends[:-1])]


def _sums_of(z: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    parts = []
    for centroids in centres:
        label = squared_distances(z, centroids).argmin(axis=1)
        member = np.equal.outer(np.arange(len(centroids)), label).astype(np.float64)
        parts.append(np.column_stack([member @ z, member.sum(axis=1)]).ravel())
    return np.concatenate(parts)


def _moved(sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, sizes); an empty regime keeps its centroid."""
    sizes = sums[:, -1].astype(np.int64)
    return np.where(sizes[:, None] > 0, sums[:, :-1] / np.maximum(sizes, 1)[:, None], centroids), sizes


def lloyd_steps(df: DataFrame, starts: list[np.ndarray], vec: str = "z", tasks: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """One step of several clusterings in one pass: (new centroids, sizes) each.  An empty regime keeps its centroid."""
    return [_moved(sums, c) for sums, c in zip(_regime_sums(df, starts, vec, tasks), starts)]


def lloyd_step(df: DataFrame, centroids: np.ndarray, vec: str = "z", tasks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, sizes)."""
    return lloyd_steps(df, [centroids], vec, tasks)[0]


@dataclass
class _Level:
    """``rows`` that can change their regime while no centroid is further than its ``reach`` from where it was (``around``), and
    the sums of all other rows (``fixed``).  The lowest level holds all rows and always applies."""

    rows: DataFrame
    tasks: int
    around: dict[int, np.ndarray] = field(default_factory=dict)
    reach: dict[int, float] = field(default_factory=dict)
    fixed: dict[int, np.ndarray] = field(default_factory=dict)
    tried: dict[int, float] = field(default_factory=dict)

    def applies(self, found: dict[int, np.ndarray], moving: list[int]) -> bool:
        return all(_furthest(found[k], self.around[k]) <= self.reach[k] for k in moving if k in self.reach)

    def worth_narrowing(self, reach: dict[int, float], found: dict[int, np.ndarray]) -> bool:
        def limit(k: int) -> float:
            most = self.reach[k] / SHRINK if k in self.reach else NEAR * _least_gap(found[k])
            return min(most, self.tried[k] / RETRY) if k in self.tried else most

        return all(r <= limit(k) for k, r in reach.items())

    def narrowed(self, reach: dict[int, float], found: dict[int, np.ndarray], vec: str) -> _Level | None:
        """The level of rows that are undecided within ``reach``, written once; None where these are most of the rows."""
        ks = list(reach)
        centres, reaches = [found[k] for k in ks], [reach[k] for k in ks]
        dims = centres[0].shape[1]
        ends = np.cumsum([len(c) * (dims + 1) for c in centres])

        def decided(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(int(ends[-1]) + 2)
            for z in _parts(batch, dims):
                held = z[~_undecided(z, centres, reaches)]
                total += np.append(_sums_of(held, centres), [len(held), len(z)])
            return total

        *sums, n_decided, n = _added_up(self.rows, [vec], decided, int(ends[-1]) + 2, self.tasks)
        if n_decided < MOSTLY * n:
            return None

        def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if blocks:
                yield from _blocks(z[_undecided(z, centres, reaches)] for batch in batches for z in _parts(batch, dims))
                return
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(_undecided(matrix(batch.column(0)).astype(np.float64), centres, reaches)))

        rows = self.rows.select(vec)
        blocks = rows.dtypes[0][1] == "binary"
        rows = materialize(rows.mapInArrow(undecided, rows.schema), "undecided")
        fixed = {k: self.fixed.get(k, 0.0) + part.reshape(-1, dims + 1) for k, part in zip(ks, np.split(np.array(sums), ends[:-1]))}
        return _Level(rows, rows.rdd.getNumPartitions(), dict(zip(ks, centres)), reach, fixed)


def _furthest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(a - b, axis=1).max())


def _least_gap(centroids: np.ndarray) -> float:
    """Distance of the two closest centroids."""
    apart = np.sqrt(squared_distances(centroids, centroids))
    return float(apart[~np.eye(len(centroids), dtype=bool)].min(initial=np.inf))


def _undecided(z: np.ndarray, centres: list[np.ndarray], reaches: list[float]) -> np.ndarray:
    """Rows that another centroid could come to own, in one of the clusterings, if each moves by no more than its reach.

    The nearest centroid can recede and any other approach by the reach, so a lead of more than twice the reach decides.
    """
    out = np.zeros(len(z), dtype=bool)
    for centroids, reach in zip(centres, reaches):
        if len(centroids) > 1:
            two = np.sqrt(np.partition(squared_distances(z, centroids), 1, axis=1)[:, :2])
            out |= ~(two[:, 1] - two[:, 0] > 2 * reach + LEAD_EPS * two[:, 1])
    return out


def _settle(rows: DataFrame, starts: dict[int, np.ndarray], vec: str, max_iter: int, tasks: int) -> tuple[dict[int, np.ndarray], int]:
    """Lloyd steps of several clusterings side by side until each stops moving: (centroids, steps).

    A step counts every row.  But once centroids move little, most rows cannot change their regime: they enter as sums
    taken once, and a step reads only the undecided rows.  Should a centroid go further than was reckoned with, the rows
    below are read again, so the centroids are those of steps over all rows.
    """
    found, moving, done = dict(starts), list(starts), 0
    levels = [_Level(rows, tasks)]
    for done in range(1, max_iter + 1):
        holds = [level.applies(found, moving) for level in levels]
        if not all(holds):
            levels = levels[:holds.index(False)]
        top, reach = levels[-1], {}
        steps = _regime_sums(top.rows, [found[k] for k in moving], vec, top.tasks)
        for k, sums in zip(list(moving), steps):
            updated, _ = _moved(sums + top.fixed.get(k, 0.0), found[k])
            if np.linalg.norm(updated - found[k]) < SHIFT_TOL:
                moving.remove(k)
            else:
                reach[k], found[k] = REACH * _furthest(updated, found[k]), updated
        if not moving:
            break
        if steps[0][:, -1].sum() >= NARROW_ROWS and top.worth_narrowing(reach, found):
            upper = top.narrowed(reach, found, vec)
            if upper is None:
                top.tried = reach
            else:
                levels.append(upper)
    return found, done


@dataclass
class Regimes:
    """Fitted centroids; assignment and probabilities are column expressions."""

    spark: SparkSession
    centroids: np.ndarray
    temperature: float = TEMPERATURE
    iterations: int = 0

    @property
    def k(self) -> int:
        return len(self.centroids)

    def assign(self, df: DataFrame, vec: str = "z", into: str = "regime") -> DataFrame:
        return self._measured(df, vec).withColumn(into, nearest_index(F.col("_d"))).drop("_d")

    def probabilities(self, df: DataFrame, vec: str = "z", into: str = "probs") -> DataFrame:
        """softmax(-temperature * distance) over the regimes."""
        weighted = self._measured(df, vec).withColumn("_w", distance_weights(F.col("_d"), self.temperature))
        return weighted.withColumn(into, normalised(F.col("_w"))).drop("_d", "_w")

    def _measured(self, df: DataFrame, vec: str) -> DataFrame:
        # A column of its own, because everything after it looks at the distances more than once.
        return df.withColumn("_d", distances_to(F.col(vec), self.centroids.tolist()))

    def table(self) -> DataFrame:
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        return self.spark.createDataFrame(rows, "regime int, centroid array<double>")

    def distances(self) -> DataFrame:
        """K x K distances: each centroid against the fixed list of all of them."""
        each = distances_to(F.col("centroid"), self.centroids.tolist())
        return self.table().select(F.col("regime").alias("i"), F.posexplode(each).alias("j", "distance"))

    @classmethod
    def from_table(cls, table: DataFrame, temperature: float = TEMPERATURE) -> Regimes:
        rows = sorted(table.collect(), key=lambda r: r["regime"])  # K rows
        return cls(table.sparkSession, np.array([r["centroid"] for r in rows]), temperature)


def fit_regimes(df: DataFrame, k: int, keys: list[str], vec: str = "z", max_iter: int = MAX_ITER, seed: int = 42,
                temperature: float = TEMPERATURE, start: np.ndarray | None = None) -> Regimes:
    """Lloyd iterations as Spark jobs over all rows, until the centroids stop moving."""
    centroids = initial_centroids(df, k, keys, vec, seed) if start is None else np.array(start, dtype=np.float64)
    found, done = _settle(df, {k: centroids}, vec, max_iter, df.rdd.getNumPartitions())
    return Regimes(df.sparkSession, found[k], temperature, done)


# ---------------------------------------------------------------------------------------------------- silhouette

def _mean_silhouettes(df: DataFrame, columns: list[str], labels_of, sizes: list[int], dims: int, tasks: int | None) -> list[float]:
    """Mean silhouette of several labelings over all rows, with squared Euclidean distances, in two passes.

    The mean squared distance from a row to a cluster follows from the cluster's size, sum and sum of squared
    norms, so nothing larger than those is shared.  ``labels_of(batch, z)`` gives one code array per labeling of the vectors ``z``.
    """
    ends = np.cumsum([k * (dims + 2) for k in sizes])

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return sum(moments_of(batch, z) for z in _parts(batch, dims))

    def moments_of(batch: pa.RecordBatch, z: np.ndarray) -> np.ndarray:
        norm = (z * z).sum(axis=1)
        parts = []
        for k, label in zip(sizes, labels_of(batch, z)):
            member = np.equal.outer(np.arange(k), label).astype(np.float64)
            parts.append(np.column_stack([member @ z, member @ norm, member.sum(axis=1)]).ravel())
        return np.concatenate(parts)

    clusters = [m.reshape(-1, dims + 2) for m in np.split(_added_up(df, columns, moments, int(ends[-1]), tasks), ends[:-1])]

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        return sum(scores_of(batch, z) for z in _parts(batch, dims))

    def scores_of(batch: pa.RecordBatch, z: np.ndarray) -> np.ndarray:
        norm, at = (z * z).sum(axis=1), np.arange(len(z))
        out = [float(len(z))]
        for m, own in zip(clusters, labels_of(batch, z)):
            n = m[:, -1]
            total = np.maximum(norm[:, None] * n - 2 * z @ m[:, :-2].T + m[:, -2], 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                within = total[at, own] / (n[own] - 1)
                others = np.where(n > 0, total / n, np.inf)
                others[at, own] = np.inf
                nearest = others.min(axis=1)
                s = (nearest - within) / np.maximum(nearest, within)
            out.append(float(np.where(n[own] > 1, np.nan_to_num(s), 0.0).sum()))
        return np.array(out)

    summed = _added_up(df, columns, scores, 1 + len(sizes), tasks)
    used = [int((m[:, -1] > 0).sum()) for m in clusters]
    return [-1.0 if u < 2 else float(np.round(t / max(summed[0], 1), 6)) for u, t in zip(used, summed[1:])]


def silhouette(df: DataFrame, labels: list[str], vec: str = "z") -> DataFrame:
    """``(labeling, score)``: mean silhouette per label column over all rows, rounded to 6; -1 when only one cluster is used.

    Distances are squared Euclidean; a singleton scores 0.  Labels may be any values of one type, at most
    ``MAX_CLUSTERS`` different ones per column.
    """
    spark = df.sparkSession
    first = df.select(vec).first()
    if first is None:
        return spark.createDataFrame([(c, -1.0) for c in labels], "labeling string, score double")
    codes = {}
    for c in labels:
        values = sorted(r[0] for r in df.select(c).distinct().limit(MAX_CLUSTERS + 1).collect())
        if len(values) > MAX_CLUSTERS:
            raise ValueError(f"{c!r} has more than {MAX_CLUSTERS} labels")
        codes[c] = {v: i for i, v in enumerate(values)}

    def labels_of(batch: pa.RecordBatch, z: np.ndarray) -> list[np.ndarray]:
        return [np.array([codes[c][v] for v in batch.column(c).to_pylist()]) for c in labels]

    means = _mean_silhouettes(df, [vec, *labels], labels_of, [len(codes[c]) for c in labels], len(first[0]), None)
    return spark.createDataFrame(list(zip(labels, means)), "labeling string, score double")


def euclidean_silhouette(df: DataFrame, label: str, keys: list[str], vec: str = "z", per_cluster: int = 200, seed: int = 42) -> DataFrame:
    """``(labeling, score, standard_error, anchors)``: the mean silhouette with Euclidean distances, estimated.

    Unlike the squared form of :func:`silhouette` it does not follow from sums per cluster.  So of every cluster the
    ``per_cluster`` rows of least seeded hash are anchors (all, if fewer); each anchor's silhouette is exact, against all
    rows, in one pass.  The score weighs the clusters' means by their sizes; its standard error is that of a stratified
    sample without replacement, 0 where every row is an anchor.  Rows with a null label or vector take no part; a singleton
    scores 0; fewer than two clusters score -1.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(vec).alias("z"), F.col(label).alias("label"), *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)])
    held = sorted((tuple(r) for r in rows.groupBy("label").count().limit(MAX_CLUSTERS + 1).collect()))
    if len(held) > MAX_CLUSTERS:
        raise ValueError(f"{label!r} has more than {MAX_CLUSTERS} labels")
    schema = "labeling string, score double, standard_error double, anchors long"
    if len(held) < 2:
        return spark.createDataFrame([(label, -1.0, 0.0, 0)], schema)
    codes, n = {v: i for i, (v, _) in enumerate(held)}, np.array([c for _, c in held], dtype=np.float64)
    if np.minimum(n, per_cluster).sum() * len(n) > ANCHOR_SUMS:
        raise ValueError(f"{len(n)} clusters of {per_cluster} anchors are too many sums; take fewer anchors")
    names = [f"key_{i}" for i in range(len(keys))]
    # Rows far above the rank are left out by a bound on the hash, so a large cluster is not sorted; without it, if too few are left.
    hashed = rows.withColumn("h", sample_key(seed, *names))
    likely = (per_cluster + 10 * per_cluster ** 0.5 + 20) / n
    bound = F.element_at(F.create_map(*[F.lit(x) for v, p in zip(codes, likely) for x in (v, format(min(int(p * 16 ** 12), 16 ** 12 - 1), "012x") + ("g" if p >= 1 else ""))]), F.col("label"))
    order = Window.partitionBy("label").orderBy("h", *names)

    def drawn(some: DataFrame) -> list:
        return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_cluster).select("z", "label").collect()

    picked = drawn(hashed.where(F.col("h") < bound))
    if len(picked) < np.minimum(n, per_cluster).sum():
        picked = drawn(hashed)
    anchors, own = np.array([r["z"] for r in picked], dtype=np.float64), np.array([codes[r["label"]] for r in picked])
    step = max(1, ANCHOR_CELLS // len(anchors))

    def distances(batch: pa.RecordBatch) -> np.ndarray:
        z, at = matrix(batch.column(0)).astype(np.float64), np.array([codes[v] for v in batch.column(1).to_pylist()])
        sums = np.zeros((len(anchors), len(n)))
        for a in range(0, len(z), step):
            member = np.equal.outer(at[a:a + step], np.arange(len(n))).astype(np.float64)
            sums += np.sqrt(squared_distances(z[a:a + step], anchors)).T @ member
        return sums.ravel()

    total = _added_up(rows, ["z", "label"], distances, len(anchors) * len(n)).reshape(len(anchors), len(n))
    each = np.arange(len(anchors))
    others = total / n
    others[each, own] = np.inf
    nearest = others.min(axis=1)
    within = total[each, own] / np.maximum(n[own] - 1, 1)
    widest = np.maximum(nearest, within)
    s = np.where((n[own] > 1) & (widest > 0), (nearest - within) / np.where(widest > 0, widest, 1), 0.0)
    score = variance = 0.0
    for c, size in enumerate(n):
        part, share = s[own == c], size / n.sum()
        score += share * part.mean()
        if 1 < len(part) < size:
            variance += share ** 2 * part.var(ddof=1) / len(part) * (1 - len(part) / size)
    return spark.createDataFrame([(label, float(score), float(np.sqrt(variance)), len(anchors))], schema)


@dataclass
class KSelection:
    table: DataFrame  # k, score, best
    best_k: int
    centroids: np.ndarray  # of the best K


def select_k(df: DataFrame, keys: list[str], vec: str = "z", k_max: int = K_MAX, seed: int = 42, max_iter: int = MAX_ITER) -> KSelection:
    """Silhouette of K = 2..k_max over all rows, and the best K (the smallest on ties).

    All K are clustered side by side, one pass per Lloyd step; a K that has converged leaves the following passes.
    """
    spark = df.sparkSession
    rows = materialize(df.select(vec, *keys), "k-search")
    seeds = np.array([r[vec] for r in rows.orderBy(sample_key(seed, *keys), *keys).limit(k_max).select(vec).collect()], dtype=np.float64)
    ks = list(range(K_MIN, len(seeds) + 1))
    if not ks:
        raise ValueError("choosing K needs at least two rows")
    rows = materialize(packed(rows, vec), "k-search-blocks")  # every step reads it
    tasks = rows.rdd.getNumPartitions()
    found, _ = _settle(rows, {k: seeds[:k] for k in ks}, vec, max_iter, tasks)

    def labels_of(batch: pa.RecordBatch, z: np.ndarray) -> list[np.ndarray]:
        return [squared_distances(z, found[k]).argmin(axis=1) for k in ks]

    scores = dict(zip(ks, _mean_silhouettes(rows, [vec], labels_of, ks, seeds.shape[1], tasks)))
    best = max(ks, key=lambda k: (scores[k], -k))
    table = spark.createDataFrame([(k, scores[k], k == best) for k in ks], "k int, score double, best boolean")
    return KSelection(table, best, found[best])
