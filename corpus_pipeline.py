"""A corpus in five stages: quality rules, near duplicates, repeated strings, source mix, packing."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtree.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from loomtree.llm.common import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words of a passage that is cut where documents share it.
REPEATED = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs).filter("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs, **near_dedup.CORPUS).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs, REPEATED, carry=("lang", "source"), as_text=True, unit="words")
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_copies), ("suffix_dedup", repeats), ("mix_sources", mix), ("best_fit_packing", pack)]

#: The stages' models and hashes have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
