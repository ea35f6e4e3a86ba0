"""Helpers shared by the operators: reading tables, scratch tables, column names that cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeflow.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def save(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """A written table under ``spark.checkpoint.dir``: cuts lineage and survives lost executors."""
    return materialize(df, label, partition_by)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column (in either case) has it."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: equal texts get equal keys, and at 1e10 texts none of the others do."""
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]


def consecutive(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal (whole-number) keys as one table each, from sorted batches."""
    at, kept = None, []
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            here = tuple(key[:, a].tolist())
            if kept and here != at:
                yield at, pa.Table.from_batches(kept)
                kept = []
            at = here
            kept.append(batch.slice(a, b - a))
    if kept:
        yield at, pa.Table.from_batches(kept)
