"""Materialised intermediate tables.

Lineage is cut by writing a parquet table under ``spark.checkpoint.dir``, the shared folder the cluster
names.  A written table survives executor loss, keeps column pruning for later reads, and pins down which
row landed in which partition -- the sampled bounds of a range shuffle may differ between two jobs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW_GROUP_CHECK = 4  # rows between size checks: packed rows are large, so row groups must be closed early


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder; only a local session without one gets a temporary folder of its own."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="regimeflow-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/regimeflow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to scratch and return the written table.

    The shuffles of the write go with it: nothing reads them again, and until the driver happens to collect its garbage
    they would lie beside the table and the shuffles of the next step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("parquet.page.size.row.check.min", ROW_GROUP_CHECK)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    kept = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
