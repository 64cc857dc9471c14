"""A training corpus from raw documents: five stages, each an operator of millrace.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, near_dup, quality, substring
from millrace.llm.common import read, store


def _whole(docs: DataFrame) -> DataFrame:
    """A document's columns as one, beside its id and text: operators add columns, and names may clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base conditions and the decision list learned from the labels."""
    rules = quality.learn_rules(docs, read(spark, sf_dir, "labels"))
    return quality.judge_quality(_whole(docs), rules).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates."""
    return near_dup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier; texts without such passages as they are."""
    rows = substring.remove_repeats(_whole(docs))
    same = F.col("_n_removed") == 0
    new = {"text": F.when(same, F.col("_row.text")).otherwise(F.col("_kept")), "n_chars": F.when(same, F.col("_row.n_chars")).otherwise(F.length("_kept").cast("long"))}
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian unsigned 32-bit) and digests of ids and decoded text."""
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("_row"), "text")
    coded = bpe.round_trip(rows, "_row", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("_row.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL can express neither the learned rules nor the samples; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
