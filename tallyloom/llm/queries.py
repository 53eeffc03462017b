"""The thin op queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, exact, html_lstm, mixing, quality, sharding, simhash, sql, topk, toxicity, urls, whitening
from .common import scratch, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.bpe_digest(docs, path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = stored(quality.features(docs).drop("text", "lang"), f"{scratch(spark)}/features")
    result = quality.judged(found, quality.references(found))
    return result.select("doc_id", *quality.FEATURES, "kept")


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    params = toxicity.learned(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic"))
    return toxicity.score(docs, params).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sharding.text_points(table(spark, sf_dir, "documents"))
    found = sharding.kd_shards(points, ("size", "n_chars", "text_crc32"), leaves=40)
    none = F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    mixed = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return mixing.in_order(mixed, "doc_id")


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_kd_shards": op5_kd_shards,
        "op6_mixing": op6_mixing,
        "op7_url_rules": op7_url_rules,
        "op8_perspectives": op8_perspectives,
        "op9_top_k": op9_top_k,
        "op10_main_text": op10_main_text,
        "op11_elkan_clusters": op11_elkan_clusters,
        "op12_whitening": op12_whitening,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    q = quality
    op2 = sql.op2(q.COMMON_WORDS, q.CLASSES, (q.CLASS_WORDS, q.CLASS_LIMIT), (q.HIST_WORDS, q.WORD_LIMIT, q.WORD_SLACK), q.REFERENCE_WORDS, q.PARTS)
    return {"op2_quality_rules": op2, "op6_mixing": sql.OP6, "op8_perspectives": sql.OP8, "op9_top_k": sql.OP9, "op11_elkan_clusters": sql.op11(), "op13_exact_dedup": sql.OP13}
