"""Repeated ids with different texts or vectors: operators against their SQL twins."""

import hashlib
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from regimeflow.llm import line_dedup, ngram_join, topk
from regimeflow.llm.queries import ORACLES
from regimeflow.shipping import ship_package
from tests.llm import brute


def twin(name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame)
    return sorted(con.execute(ORACLES[name]).fetchall(), key=str)


def test_top_k_ranks_every_query_row_by_itself(spark):
    ship_package(spark)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)]
    rows += [(20, [1.0] * 4), (20, [-1.0] * 4), (40, rows[40][1]), (7, [0.5] * 4)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, candidates=16, queries=2, stripe=2)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()), key=str)
    assert got == twin("op4_topk", embeddings=pd.DataFrame(rows, columns=["vec_id", "embedding"]))


def test_line_dedup_counts_documents_by_id(spark):
    line, other = "a line of more than forty code points, held by all", "another line of more than forty code points, too"
    rows = [(1, f"{line}\n{i}\n{other}") for i in range(4)] + [(2, line), (None, other), (None, f"x\n{other}"), (None, None)]
    rows += [(i, f"{other}\nown {i}") for i in (3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in line_dedup.dedup_lines(df).collect()]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    assert sorted(got, key=str) == twin("op8_line_dedup", documents=frame)
    assert sum(n for _, _, n, _ in got) == 4 + 2 + 2  # only the second line is common: it goes in 1, those without id, 3 and 4


def test_ngram_join_links_every_text_of_a_repeated_id(spark):
    """Each row links by its own text; against plain search over rows numbered apart."""
    ship_package(spark)
    rng = random.Random(4)
    b, other, third = (brute.sentence(rng, 100) for _ in range(3))
    rows = [(3, b), (3, other), (4, b + " y"), (2, other + " z"), (3, b), (3, "x " + b), (5, third), (5, third + " w"), (None, b), (6, ""), (6, None), (6, third)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    plain = brute.jaccard_components([(i, t) for i, (d, t) in enumerate(rows) if d is not None], 3, 90)
    want = []
    for i, (doc, _) in enumerate(rows):
        if doc is None:
            continue
        n, c = plain[i]
        want.append((doc, n, min(rows[j][0] for j, (_, k) in plain.items() if k == c)))
    assert sorted([r for r in got if r[0] is not None], key=str) == sorted(want, key=str)
    assert (4, 99, 3) in got and (3, 98, 2) in got and [r[2] for r in got if r[0] is None] == [None]
