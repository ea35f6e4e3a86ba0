"""Delimited text output; parquet is written with ``df.write.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from regimeflow.sources.events import DIALECT

MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """A folder of text files, one per task, with full-precision timestamps."""
    (
        df.write.mode("overwrite").options(sep=sep, header=header, **DIALECT)
        .option("timestampNTZFormat", MICROSECONDS).option("timestampFormat", MICROSECONDS + "XXX").csv(path)
    )
