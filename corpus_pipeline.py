"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of `documents`.

Defined cases: null, empty and letter-less texts are rejected by the first stage; very long texts are worked on whole; extra columns
of any name go through unchanged; rows that repeat a doc_id are documents of
their own unless their texts are near-duplicates; rows without a doc_id stay; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.llm import dartminhash, decontaminate, langid, packing, suffix_dedup
from watchtide.session import cut_lineage


CORE = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def plain_names(stage: Stage) -> Stage:
    """Other columns than those of `documents` have names in a stage that nothing of its own can clash with."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[c if c in CORE else f"extra_{k}" for k, c in enumerate(names)]), sf_dir).toDF(*names)

    return run


@plain_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or if no language is known, go; mixed texts stay."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).where(F.col("_lang.pred") != "und").select(*docs.columns)


@plain_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays, once.

    A row is known by a 64-bit number of its doc_id and text, so texts that share a doc_id are told apart; of n rows two share a
    number with a chance of n^2 / 4e19.
    """
    named = docs.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    classes = dartminhash.near_duplicates(named.select(F.col("key").alias("doc_id"), "text"))
    ids = named.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("name")).distinct()
    first = classes.distinct().join(ids, "doc_id").groupBy("class_id").agg(F.min(F.struct("name", "doc_id"))["doc_id"].alias("key"))
    kept = named.join(first.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


@plain_names
def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in an earlier document go; what is left of a document stays."""
    return suffix_dedup.remove(docs)


@plain_names
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; the rest of a document stays."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_repeats),
    ("decontamination", benchmark_passages),
    ("packing", best_fit_packing),
]

#: Trained models, signatures and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if k else docs, sf_dir)
    return docs
