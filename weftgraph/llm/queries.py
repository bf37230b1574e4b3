"""The registered queries of this subpackage; each returns an operator's full result over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, language, lm_scoring, minhash, nndescent, packing, sharding, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score(docs, good, lm_scoring.train(docs, good))


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    read = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings")).drop("audit_recall")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sharding, op2_language_id, op3_toxicity, op4_best_fit_packing, op5_token_counts, op6_lm_scoring,
        op7_chat_formatting, op8_decontamination, op9_minhash_dedup, op10_nn_descent,
    )
    return {f.__name__: f for f in found}


_SQL7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<turn/>', '<\turn/>'), '### ', '#\## ') AS x,
    replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '<turn/>', '<\turn/>'), '### ', '#\## '), chr(10), '\n') AS r,
    CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS opens
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN opens = 1 THEN length(r) + 14 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_SQL9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.node
"""

_SQL10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": _SQL7, "op9_minhash_dedup": _SQL9, "op10_nn_descent": _SQL10}
