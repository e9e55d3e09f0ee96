"""The queries of this folder's operators: each over its whole table, with production parameters."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_dedup, packing, piecewise_hash, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, url_rules
from .common import materialize, small, table

#: Words of a passage that op9 reports besides strings of 400 bytes.
PASSAGE = 50


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piecewise_hash.with_edited_neighbours(table(spark, sf_dir, "documents"))
    near = lambda x: piecewise_hash.likeness(F.col("fingerprint"), F.col(x)).cast("double")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), white_space_splits=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from strings of 400 bytes; and n_passage_words, words in repeated passages of `PASSAGE` words or more,
    many of which have fewer bytes than 400."""
    docs = table(spark, sf_dir, "documents")
    found = suffix_dedup.remove_repeats(docs)
    passages = materialize(suffix_dedup.covered(docs, PASSAGE, "words"), "passages").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    found = found.join(small(passages), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("n_covered", F.lit(0)).cast("long").alias("n_passage_words")
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_classes(table(spark, sf_dir, "documents"), **near_dedup.CORPUS)
    return found.select("doc_id", "n_words", "class_id", "class_size", "keep")


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_piecewise_hash, op3_token_counts, op4_best_fit_packing, op5_url_rules, op6_quality_classifier, op7_quality_rules, op8_sharding, op9_suffix_dedup, op10_near_dedup)
}
