"""A corpus pipeline of the operators in weftline.llm; each stage is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, packing, quality, secret_scan, shingle_join
from weftline.llm.common import cut
from weftline.llm.queries import TOKENIZER, mix_path, mix_weights

#: The words of the mix, as a part of those that reach it. Below 1, so that target weights can be met without repeats.
MIX_SHARE = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is below 0.7.

    Null and empty texts are scored like others; equal texts have equal scores, so repeated rows stay or go together; labels without a document are
    ignored, and without any label all scores are 0.5, so nothing stays; an empty table gives an empty one.
    """
    return cut(quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "good_quality")  # so that Python gets texts in small batches


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays; of rows with the same doc_id and text, one.

    Documents without words are in no group and stay. A document with several texts of one doc_id stays whole or goes whole. An empty table gives an empty one.
    Rows without a doc_id get one by their text, above all others: they stay only if no row of their group has a doc_id, and once.
    """
    top = max(docs.agg(F.max("doc_id")).first()[0] or 0, 0)
    made = F.lit(top + 1) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1)
    named = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made))
    groups = shingle_join.jaccard_components(named, key="_id").where("component_id <> _id").select("_id")
    kept = named.join(groups, "_id", "left_anti")
    again = cut(named.groupBy("_id").count().where("count > 1").select("_id"), "repeated_ids")
    if not again.isEmpty():
        kept = kept.join(again, "_id", "left_anti").unionByName(kept.join(again, "_id", "left_semi").dropDuplicates(["_id", "text"]))
    return kept.select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows. All rows stay: null texts and texts without secrets as they are, repeated rows alike, an empty table empty."""
    clean = secret_scan.redact(docs)
    return cut(clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))), "without_secrets")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, each document once at most.

    A leaf's documents come in the order of a digest of their doc_id, ties by doc_id; it ends before the first one that passes its budget. Null and empty texts
    cost nothing and stay if they come before that; null languages and sources are branches of their own; repeated rows are documents of their own; an empty table gives an empty one.
    """
    return mixing.mix_sources(docs, mix_path(), mix_weights(), share=MIX_SHARE, seed=1).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null or empty text is one closing id; repeated rows are packed each; an empty table gives an empty one.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path(TOKENIZER), capacity=packing.CAPACITY)
    return packing.pack(pieces, capacity=packing.CAPACITY)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
