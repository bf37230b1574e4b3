"""A corpus-cleaning pipeline over ``documents``: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
rereads. All but the last return the columns of documents; the last returns the packing plan.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, language, minhash, packing, toxicity
from weftgraph.llm.storage import materialise, release, without

#: A document goes if less than this share of its letters is in its main language.
MIN_LANGUAGE_SHARE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang for the operators, and the whole row. The operators get a hash of doc_id and text as
    doc_id: a verdict is on a row, not on all rows that share its doc_id."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    return docs.select(key.alias("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The whole rows whose key (doc_id) isn't rejected."""
    return without(rows, rejected.select("doc_id").distinct()).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones among them) and texts that are mostly outside their main
    language. Learns from ``lang`` of the documents themselves, held-out ones excepted; if none has a lang, all
    texts are of no language and go. Rows that repeat get one verdict; an empty table stays empty."""
    model = language.train(docs.select("doc_id", "text", "lang").where(~language.held_out(F.col("doc_id"))))
    rows = _rows(docs)
    found = language.identify(rows, model)
    return _without(rows, found.where(f"lang_pred = '{language.UNDETERMINED}' or score < {MIN_LANGUAGE_SHARE}"))


def toxicity_grades(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the ordinal model holds for toxic. A null or empty text isn't; labels of other documents
    than those left count for nothing; without toxic labels nothing goes. Rows that repeat get one verdict."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _rows(docs)
    return _without(rows, toxicity.grade(rows, model).where("toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): one of the smallest doc_id.
    Of rows that repeat doc_id and text one stays. Rows of one doc_id and different texts are documents of their own.
    Rows of a null doc_id and documents without words (null or empty texts) all stay."""
    rows = _rows(docs)
    keyed = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("text"), F.col("doc_id").alias("key"))
    found = minhash.near_duplicates(keyed, shingle=5, percent=80, carry=["key"]).where("doc_id is not null and n_shingles > 0")
    found = materialise(found.select("doc_id", "kept", "group_key", "key"), "near")
    first = found.where("kept").groupBy("group_key").agg(F.min("key").alias("key"))
    rejected = found.select("key").distinct().join(first, "key", "left_anti").withColumnRenamed("key", "doc_id")
    repeated = found.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("doc_id"))
    repeated = materialise(repeated, "repeated")
    left = without(rows, rejected)
    if repeated.limit(1).count():
        left = materialise(left, "left")
        left = without(left, repeated).unionByName(minhash.semi_join(left, repeated, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("row").alias("row")))
    release(found)
    return left.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a passage of a benchmark item. Null and empty texts and items match nothing; without items
    nothing goes. Rows that repeat get one verdict."""
    rows = _rows(docs)
    return _without(rows, decontaminate.matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens. A null text is packed as an empty one; repeated rows are packed
    each; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_grades),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Viterbi, regression, signatures and packing have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
