"""Reproducible sampling without replacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PREFIX_HEX = 12


def sample_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, size: int, keys: list[str], seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """The ``size`` rows with the smallest md5 of (seed, keys); the whole table when it is no larger.

    Rows above a hash threshold chosen to leave a little more than ``size`` are dropped before the top-n, so the
    final merge sees about ``size`` rows however many partitions there are.  Should too few survive, the top-n
    runs over everything, so the result is always the same rows.
    """
    n = df.count() if n_rows is None else n_rows
    if n <= size:
        return df
    hashed = df.withColumn("_hash", sample_key(seed, *keys))
    keep = (size + 10 * math.sqrt(size) + 20) / n
    pool = hashed
    if keep < 0.5:
        limit = format(int(keep * 16 ** _PREFIX_HEX), f"0{_PREFIX_HEX}x")
        below = hashed.where(F.col("_hash") < limit)
        if below.count() >= size:
            pool = below
    return pool.orderBy("_hash", *keys).limit(size).drop("_hash")
