"""The corpus pipeline: stages that each work on all their predecessor kept.

1. ``toxicity``: documents that the pattern grammar scores 0.5 or more go.
2. ``line_dedup``: repeated lines go, except in the largest document holding them; every document stays.
3. ``ngram_join``: of documents linked by n-gram Jaccard similarity the one with the least id stays (five-word
   shingles, 0.8).
4. ``decontaminate``: documents that overlap with a benchmark item go.
5. ``byte_bpe``: every document is encoded; its text is what the decoded ids say, next to ids and counts.

Each stage treats nulls, empty texts, ties, repeated rows and empty tables as its operator states.  All but the last
return the columns of ``documents``, ``n_chars`` following the text.  Stage 3 takes every row as a document: rows that
repeat a doc_id fall to one only where their texts are linked, rows without doc_id or words are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeflow.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from regimeflow.llm.common import documents, save, table
from regimeflow.llm.queries import BYTE_RANKS, tokenizer_file
from regimeflow.shipping import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the grammar does not reject; fitted on labelled rows outside the held-out fifth."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, grammar)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that larger documents repeat."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id names the group."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    rows = save(ngram_join.jaccard_groups(docs, NEAR_WIDTH, NEAR_PERCENT).where(F.col("group").isNotNull()).select("doc", "text_hash", "component", "group"), "near")
    # Of the rows of a group those of its least doc_id stay, and of these the ones of the least text hash.
    least = rows.where("doc = component").groupBy("group").agg(F.min("text_hash").alias("least"))
    away = rows.join(least, "group").where("doc <> component or text_hash <> least").select("doc", "text_hash").distinct()
    there = (F.col("doc_id") == F.col("doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    kept = docs.join(away, there, "left_anti")
    twice = save(rows.where("doc = component").groupBy("doc", "text_hash").count().where("count > 1").drop("count"), "repeated")
    if twice.isEmpty():
        return kept
    # Rows with one doc_id and one text: the first in the order of their other columns stays, found with partial sums.
    again = kept.join(twice, there, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return kept.join(twice, there, "left_anti").unionByName(again.select("doc_id", "text", "row.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no benchmark item."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the decoded text, number of tokens and ids (little-endian unsigned 32-bit) of every document."""
    ship_package(spark)
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("doc"), "text")
    out = byte_bpe.encode(keyed, tokenizer_file(BYTE_RANKS), key="doc")
    return out.select("doc.*", F.decode("decoded", "UTF-8").alias("text"), "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("decontaminate", drop_benchmark), ("byte_bpe", encode)]

ORACLE_SQL = None  # the stages that learn, hash or merge cannot be said in SQL; the tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
