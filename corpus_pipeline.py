"""A training corpus from `documents`: filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. Quality and toxicity drop what they reject; of each
group of near-duplicates the least doc_id stays; mixing repeats a document as often as at
least half of it is due and drops those that never are, in the order of their training
positions; encoding returns each row's tokens by number and digest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, mixing, quality, simhash, toxicity
from tallyloom.llm.common import cleaned, drop_path, scratch, stored
from tallyloom.llm.queries import held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    params = toxicity.learned(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic"))
    return toxicity.score(docs.select(COLUMNS), params).filter("predicted = 0").select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a doc_id stay; of each component one row. A row is told by its doc_id and its text's hash."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("key"))
    found = simhash.near_duplicates(docs.select(F.expr("if(doc_id is null, null, struct(doc_id, key))").alias("id"), "text"), "id")
    heads = stored(found.filter("id = component_id").groupBy("id").agg(F.count("*").alias("n")), f"{scratch(spark)}/heads")
    gone = found.filter("id is not null and id <> component_id").select("id.*").distinct()
    kept = docs.join(gone, ["doc_id", "key"], "left_anti")
    if heads.filter("n > 1").isEmpty():
        return kept.select(COLUMNS)
    again = heads.filter("n > 1").select("id.*")
    once = kept.join(again, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return kept.join(again, ["doc_id", "key"], "left_anti").select(COLUMNS).union(once.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=COLUMNS).filter("copies > 0")
    rows = mixed.select("carried", F.explode(F.slice("positions", F.lit(1), F.col("copies").cast("int"))).alias("position"), F.col("doc_id").alias("tie"))
    return mixing.in_order(rows, "tie").select("carried.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.bpe_digest(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: Toxicity is a trained network, so SQL can't express the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    path, docs = scratch(spark), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with cleaned(spark):  # a stage's own tables go once its rows are stored, and then its input
            docs = stored(stage(spark, docs, sf_dir), f"{path}/{n}")
        if n:
            drop_path(spark, f"{path}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
