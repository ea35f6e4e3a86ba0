"""The widest tables of the operators on pairs go through one shuffle only, since disk is what they run out of."""

import time

import pytest
from pyspark.sql import functions as F

from regimeflow import scratch
from regimeflow.llm import byte_bpe, ngram_join, substring_dedup
from regimeflow.llm.queries import BYTE_RANKS, tokenizer_file


def written_plans(monkeypatch, module) -> dict[str, str]:
    plans, original = {}, module.save

    def save(df, label, *more):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return original(df, label, *more)

    monkeypatch.setattr(module, "save", save)
    return plans


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:100 + i % 3])) for i in range(12)] + [(20, "other words here"), (21, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_windows_are_shuffled_once(docs, monkeypatch):
    plans = written_plans(monkeypatch, substring_dedup)
    assert substring_dedup.repeated_passages(docs).count() > 0
    assert plans["shared-windows"].count("hashpartitioning(low") == 1


def test_pieces_are_shuffled_once(docs, monkeypatch):
    plans = written_plans(monkeypatch, ngram_join)
    assert ngram_join.jaccard_components(docs).where("component_id = 0").count() == 12
    assert plans["meetings"].count("hashpartitioning(piece") == 1


def test_stretches_travel_as_text(docs, monkeypatch):
    kinds, original = {}, substring_dedup.save
    monkeypatch.setattr(substring_dedup, "save", lambda df, label: kinds.setdefault(label, dict(df.dtypes)) and original(df, label))
    found = substring_dedup.repeated_passages(docs).where("doc_id = 2").collect()
    assert kinds["stretches"]["part"] == "binary"
    assert [(r["start_word"], r["n_words"], r["ref_doc_id"], r["ref_start_word"], r["ref_n_words"]) for r in found if r["ref_doc_id"] == 0] == [(0, 100, 0, 0, 100)]


def test_the_shuffles_of_a_written_table_go_with_the_write(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.conf.set(scratch.FILE_CLEANUP, "false")

    def files():
        return {x for x in local.getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}

    try:
        before = files()
        rows = spark.range(1000, numPartitions=3).withColumn("k", F.col("id") % 7).repartition(4, "k")
        assert len(scratch.materialize(rows, "cleaned").collect()) == 1000
        until = time.monotonic() + 10  # they are removed without waiting
        while files() - before and time.monotonic() < until:
            time.sleep(0.1)
        assert not files() - before
        assert spark.conf.get(scratch.FILE_CLEANUP) == "false"
    finally:
        spark.conf.unset(scratch.FILE_CLEANUP)


def test_no_exchange_below_the_fold_of_frequent_pieces(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"some words are in all texts, {i} of them or {i * i}") for i in range(40)], "doc_id long, text string").repartition(4)
    path, plans = tokenizer_file(BYTE_RANKS), []
    plain = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(texts, path).collect()}
    original = type(texts).toArrow
    monkeypatch.setattr(byte_bpe, "CACHE_DOCS", 20)
    monkeypatch.setattr(type(texts), "toArrow", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df))
    assert {r["doc_id"]: r["ids"] for r in byte_bpe.encode(texts, path).collect()} == plain
    assert len(plans) == 1 and "Exchange" not in plans[0]
