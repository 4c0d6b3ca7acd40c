"""From raw documents to token ids in five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialspark.llm import bpe, decontam, langid, near_copies, pii, queries
from serialspark.llm.common import delete, drop_tables, mark_tables, read, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a known language."""
    return langid.keep_known(docs, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8): the one with the smallest id. Rows without an id stay."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal numbers, dates and mail names, and their new lengths."""
    return pii.pseudonymize(docs, queries.PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, in place of their texts, and the hash of what they decode to."""
    return bpe.encode_decode(docs, queries.vocabulary("word_bpe_49k.json"), "n_tokens", "ids", "decoded_sha256").drop("text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("token_ids", token_ids)]
#: SQL has no field models, SimHash or byte pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages wrote on the way is deleted as soon as the next stage is stored."""
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        mark = mark_tables()
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/serialspark/pipeline-{uuid.uuid4().hex}/{i}_{name}"
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_tables(spark, mark)
        if before:
            delete(spark, before)
        before = path
    return docs
