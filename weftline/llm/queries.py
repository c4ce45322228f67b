"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cosine_dedup, exact_dedup, fixity, kd_shards, mixing, packing, quality, resampling, secret_scan, shingle_join, spelling, token_counts, topk_search
from .common import cut
from .sql import ORACLE_SQL  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages against a replica in which records with certain page ids are overwritten or lack."""
    records = cut(fixity.archive(table(spark, sf_dir, "pages")), "archive")
    overwritten = F.when(F.col("key") % 97 == 13, F.expr("overlay(payload placing X'00' from 9)")).otherwise(F.col("payload"))
    replica = records.where(F.col("key") % 101 != 7).withColumn("payload", overwritten)
    found = fixity.audit(records, replica)
    return found.join(records.select("file", "offset", F.col("key").alias("page_id")), ["file", "offset"])


def mix_path() -> dict[str, Column]:
    """Levels of the mixing tree: the domain is made from the number at the end of the source's name."""
    return {
        "domain": F.coalesce(F.concat(F.lit("d"), F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 5").cast("string")), F.lit("other")),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }


def mix_weights() -> list[Column]:
    return [
        F.expr("case domain when 'd0' then 30 when 'd1' then 25 when 'd2' then 20 when 'd3' then 15 when 'd4' then 10 else 5 end"),
        F.expr("case lang when 'en' then 6 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end"),
        F.lit(1),
    ]


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many words as there are, each document at most four times."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), mix_path(), mix_weights(), epochs=4, seed=1)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048)
    return packing.pack(pieces, capacity=2048)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By length, source and language, 24 leaves of near-equal bytes."""
    docs = table(spark, sf_dir, "documents")
    top = (1 << 20) - 1
    dimensions = [F.least(F.length("text"), F.lit(top)), F.pmod(F.xxhash64("source"), F.lit(1 << 20)), F.pmod(F.xxhash64("lang"), F.lit(1 << 20))]
    found = kd_shards.kd_shards(docs, dimensions, shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_dedup.cosine_components(table(spark, sf_dir, "embeddings"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of all texts that may have seven characters or more; a CRC-32 of id and run decides whether and where a letter is deleted."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]{7,}"), F.lit(0))).alias("run"))
    run, n = F.col("run"), F.length("run")
    runs = runs.select("doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), run).cast("binary")))
    at = (F.col("h") % n).cast("int")
    return runs.select(F.when(F.col("h") % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(noisy_words(table(spark, sf_dir, "documents")), 7, 2)
    return spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, share=(10, 100), least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_merkle_fixity, op3_mixing_sources, op4_exact_topk, op5_best_fit_packing,
        op6_token_counts, op7_quality_classifier, op8_kd_shards, op9_embedding_dedup, op10_secret_scans,
        op11_spelling_variants, op12_target_resampling, op13_exact_dedup,
    )
}
