"""Hard negatives against plain integer products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.llm import hard_negatives as H
from regimeflow.shipping import ship_package

SCHEMA = "vec_id long, embedding array<double>, label int, score int, `row` string"


def brute(rows, every, low=50, high=95):
    kept = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [int(np.floor(256 * x)) for x in v], label))
    out = []
    for i, (a, v, label) in enumerate(kept):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, w, other in kept]
        positives = sorted((s, b) for s, b, other in scored if other == label and b != a)[:5]
        for s, p in positives:
            allowed = sorted((t, b) for t, b, other in scored if other != label and low * -s <= 100 * -t <= high * -s)[:3]
            out += [(a, p, rank, b, -s, -t) for rank, (t, b) in enumerate(allowed, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect())


def vectors(seed, n, dims=6, labels=3, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, 0.25, 0.5, rng.random() * scale]) for _ in range(dims)], rng.randrange(labels), 0, "x") for i in range(n)]


@pytest.mark.parametrize("bound", [1, 10_000, 1 << 30, (1 << 56) - 1])
def test_products_are_exact(bound):
    rng = np.random.default_rng(bound % 97)
    dims = 3000
    limit = max(1, int((bound / dims) ** 0.5))
    a, b = (rng.integers(-limit, limit + 1, (5, dims)) for _ in range(2))
    a[0], b[0], b[1] = limit, limit, -limit  # the extremes
    primes = H.moduli(max(bound, limit * limit * dims))
    got = H.product(H.residues(a.astype(float), primes), H.residues(b.astype(float), primes), primes)
    assert (got == a @ b.T).all()


@pytest.mark.parametrize("stripe_bytes", [16 << 20, 1])
def test_mining_equals_brute_force(spark, stripe_bytes):
    ship_package(spark)
    rows = vectors(1, 700, labels=2)  # two labels, many ties, several stripes
    assert mined(spark, rows, 10, stripe_bytes=stripe_bytes, anchors=16) == brute(rows, 10)


def test_odd_rows(spark):
    ship_package(spark)
    rows = vectors(2, 60)
    rows += [(None, [1.0], 0, 0, ""), (70, None, 0, 0, ""), (80, [1.0, None], 1, 0, ""), (90, [float("nan")], 1, 0, ""), (100, [float("inf")], 0, 0, ""),
             (110, [1.0, 0.5], None, 0, ""), (120, [], 0, 0, ""), (130, [0.5, 0.5], 1, 0, ""), (140, [-1.0] * 6, 2, 0, "")]
    rows += [rows[0], rows[10], (20, [0.9] * 6, 1, 0, "")]  # repeated rows, and an id with two vectors
    assert mined(spark, rows, 10) == brute(rows, 10)
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 0, 0, "")], 10) == []
    assert mined(spark, [(i, [0.0], i % 2, 0, "") for i in range(6)], 2) == brute([(i, [0.0], i % 2) for i in range(6)], 2)


def test_large_components(spark):
    ship_package(spark)
    rows = vectors(3, 40, scale=2.0 ** 18)
    assert mined(spark, rows, 5) == brute(rows, 5)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e12], 0, 0, "")], 5)
