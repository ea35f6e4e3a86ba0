"""Event table readers: parquet, comma or tab separated text, with or without a header line."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 58 positional columns of a headerless event file, in order.
EVENT_COLUMNS = [
    "GlobalEventID", "Day", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode",
    "Actor1EthnicCode", "Actor1Religion1Code", "Actor1Religion2Code",
    "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode",
    "Actor2EthnicCode", "Actor2Religion1Code", "Actor2Religion2Code",
    "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode",
    "QuadClass", "GoldsteinScale", "NumMentions", "NumSources",
    "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode",
    "Actor1Geo_ADM1Code", "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode",
    "Actor2Geo_ADM1Code", "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_FullName", "ActionGeo_CountryCode",
    "ActionGeo_ADM1Code", "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID",
    "DATEADDED", "SOURCEURL",
]
HEADERLESS_MIN_COLUMNS = 55  # fixed value
DIALECT = {"quote": '"', "escape": '"'}  # a quote inside a quoted cell is doubled

_LONG = {"GlobalEventID", "DATEADDED"}
_INT = {"Day", "MonthYear", "Year", "IsRootEvent", "QuadClass", "NumMentions", "NumSources", "NumArticles",
        "Actor1Geo_Type", "Actor2Geo_Type", "ActionGeo_Type"}
_DOUBLE = {"FractionDate", "GoldsteinScale", "AvgTone"}


def event_schema() -> T.StructType:
    """Explicit types for the positional columns, so no inference pass reads the file twice."""
    def dtype(name: str) -> T.DataType:
        if name in _LONG:
            return T.LongType()
        if name in _INT:
            return T.IntegerType()
        if name in _DOUBLE or name.endswith(("_Lat", "_Long")):
            return T.DoubleType()
        return T.StringType()

    return T.StructType([T.StructField(c, dtype(c)) for c in EVENT_COLUMNS])


def positional_names(width: int) -> list[str]:
    """The standard names, then numbered ones for columns beyond them."""
    return [*EVENT_COLUMNS[:width], *(f"Column{i + 1}" for i in range(len(EVENT_COLUMNS), width))]


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


@contextmanager
def _missing_as_file_not_found(path: str) -> Iterator[None]:
    try:
        yield
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such path: {path}") from None
        raise


def detect_header(spark: SparkSession, path: str, sep: str) -> tuple[bool, int]:
    """(has a header line, number of columns), judged from the first line alone."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return False, 0
    cells = next(csv.reader([first[0][0]], delimiter=sep))
    return not (cells[0].strip().isdigit() or len(cells) >= HEADERLESS_MIN_COLUMNS), len(cells)


def read_events(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str | None = None,
    header: bool | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Scan of ``.parquet``, ``.csv`` or ``.tsv``.

    ``sep``, ``header`` and ``schema`` are detected only where unset.  A headerless file keeps all its columns under the
    standard names, in their standard types where every value fits and as text where one does not (one counting
    pass); a headed one takes its own names and inferred types.  Quotes inside quoted cells are doubled;
    ``multi_line`` reads cells that hold line breaks, at the price of one task per file.
    """
    suffix = _suffix(path)
    if suffix not in (".parquet", ".csv", ".tsv"):
        raise ValueError(f"unsupported file type {suffix!r}: use .parquet, .csv or .tsv")
    with _missing_as_file_not_found(path):
        if suffix == ".parquet":
            reader = spark.read if schema is None else spark.read.schema(schema)
            return reader.parquet(path)
        sep = sep or ("\t" if suffix == ".tsv" else ",")
        if header is None:
            header, _ = detect_header(spark, path, sep)
        reader = spark.read.options(sep=sep, header=header, multiLine=multi_line, **DIALECT)
        if schema is not None:
            return reader.schema(schema).csv(path)
        if header:
            return reader.option("inferSchema", True).csv(path)
        names = positional_names(detect_header(spark, path, sep)[1])
        return _typed(reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path))


def _typed(text: DataFrame) -> DataFrame:
    """Standard types for the columns whose every value fits."""
    wanted = {f.name: f.dataType for f in event_schema() if f.name in text.columns and not isinstance(f.dataType, T.StringType)}
    if not wanted:
        return text
    misfits = text.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in wanted.items()]).first()
    return text.select(*[F.col(c).try_cast(wanted[c]).alias(c) if c in wanted and not misfits[c] else F.col(c) for c in text.columns])


def assign_names(df: DataFrame, names: list[str] = EVENT_COLUMNS) -> DataFrame:
    """Positional rename for tables whose first column name is a number; other tables pass through."""
    if not re.fullmatch(r"(_c)?\d+", df.columns[0]):
        return df
    if len(df.columns) > len(names):
        raise ValueError(f"{len(df.columns)} columns but only {len(names)} names")
    return df.toDF(*names[: len(df.columns)])


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
