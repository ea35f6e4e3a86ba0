"""The registered queries of the subpackage: thin digests over the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeflow.llm import (
    byte_bpe, conversation_repair, decontaminate, hard_negatives, line_dedup, ngram_join, packing, secrets, sharding, substring_dedup,
    token_counts, topk, toxicity)
from regimeflow.llm.common import documents, table, text_or_empty

BYTE_RANKS, WORD_BPE, BYTE_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op2_decontaminate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, grammar).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLES["op4_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 20
"""


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op5_secrets(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op6_byte_bpe(spark, sf_dir):
    out = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(BYTE_RANKS))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op8_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


# The class of white space written out: space and the code points 9 to 13.
ORACLES["op8_line_dedup"] = """
WITH lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM common.last AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


@query
def op9_sharding(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(WORD_BPE))


@query
def op11_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(BYTE_BPE))


@query
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, label)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, b.rid AS other, b.vec_id, b.label,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0),
positives AS (
  SELECT anchor, other, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5)
SELECT s.anchor_id, p.positive_id, row_number() OVER (PARTITION BY s.anchor, p.other ORDER BY s.score DESC, s.vec_id, s.other)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor
WHERE s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY s.anchor, p.other ORDER BY s.score DESC, s.vec_id, s.other) <= 3
"""


@query
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair(conversation_repair.damaged(rows))
    return conversation_repair.with_empty(conversation_repair.report(repaired), rows)
