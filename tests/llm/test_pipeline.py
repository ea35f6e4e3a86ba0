"""The stages on a small corpus, each against what brute force keeps."""

import random

import pytest

import corpus_pipeline
from regimeflow.shipping import ship_package
from tests.llm import brute
from tests.llm.test_llm import toxic_rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    ship_package(spark)
    rng = random.Random(11)
    rows, labels = toxic_rows()
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs += [(1000 + r[0], *r[1:5]) for r in brute.documents(3)]
    item = brute.sentence(rng, 30)
    docs += [(5000, brute.sentence(rng, 40) + " " + item, "en", "s", 1), (None, "no id", None, None, None)]
    docs.append(next(d for d in docs if d[0] == 1001))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs.collect()
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        held.append((name, docs.collect()))
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    after = dict(held)
    toxic = {i for i, t in labels.items() if t}
    kept = {r["doc_id"] for r in after["toxicity"]}
    assert len(kept & toxic) <= 0.03 * len(toxic)
    assert all(r["doc_id"] in kept for r in before if r["doc_id"] not in toxic and r["doc_id"] is not None)
    lines = after["line_dedup"]
    assert len(lines) == len(after["toxicity"])
    assert all(r["n_chars"] == len(r["text"]) for r in lines if r["text"] is not None)
    once = list({r["doc_id"]: (r["doc_id"], r["text"]) for r in lines if r["doc_id"] is not None}.values())
    want = {i for i, (_, c) in brute.jaccard_components(once, 5, 80).items() if i == c}
    left = [r["doc_id"] for r in after["ngram_join"]]
    assert sorted({i for i in left if i is not None}) == sorted(want)
    words = [r["doc_id"] for r in after["ngram_join"] if r["doc_id"] is not None and (r["text"] or "").split()]
    assert len(words) == len(set(words))
    clean = {r["doc_id"] for r in after["decontaminate"]}
    assert 5000 not in clean and set(left) - clean == {5000}
    assert {(r["doc_id"], r["text"] or "") for r in after["byte_bpe"]} == {(r["doc_id"], r["text"] or "") for r in after["decontaminate"]}


def test_near_copies_by_row(spark, sf_dir):
    """Rows of one doc_id: linked texts fall to one row, other texts stay."""
    rng = random.Random(12)
    a, b, c = (brute.sentence(rng, 80) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, a, "de", "s", 1), (1, a, None, "s", 1), (1, b, "en", "s", 1), (2, a + " x", "en", "s", 1), (3, b, "en", "s", 1),
            (1, "y " + a, "en", "s", 1), (4, c, "en", "s", 1), (4, "", "en", "s", 1), (4, None, "en", "s", 1), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()]
    assert len(kept) == 6 and set(rows[7:]) | {rows[3]} <= set(kept)
    (one,) = set(kept) - {*rows[7:], rows[3]}
    assert one in (rows[2], rows[6])  # of the group of a: one row of doc 1


def test_stages_take_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for folder in (sf_dir, str(tmp_path)):
            out = stage(spark, empty, folder)
            assert out.count() == 0 and (name == "byte_bpe" or out.columns == corpus_pipeline.COLUMNS)
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20")
    assert corpus_pipeline.drop_toxic(spark, some, str(tmp_path)).count() == some.count()
    assert corpus_pipeline.drop_benchmark(spark, some, str(tmp_path)).count() == some.count()
