"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.llm import bpe, decontaminate, jaccard_join, quality_rules, substring_dedup
from papertide.llm.shared import row_key, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that much of their host repeats.

    Null and empty texts have too few words and go.  Repeated rows have one verdict; a null host is a host.
    """
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (null last) and then text digest, of each group of linked rows.

    Of repeated rows one stays.  Texts without words are linked with nothing: each such row that differs from the others stays.
    """
    key = F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    keyed = docs.withColumn("__key", key)
    found = jaccard_join.similar(keyed, id_col="__key").where(F.col("__key").eqNullSafe(F.col("component_id"))).select("__key").distinct()
    one = keyed.join(found, "__key", "left_semi").groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return one.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; those that lost words have the others joined by one space.

    What is kept goes back to the rows by id and text, so rows of one id, or without any, get their own.  All rows stay, null and empty texts as they are.
    """
    found = substring_dedup.remove_repeated(docs).where("n_removed > 0").select(F.col("rid").alias("__rid"), F.col("kept_text").alias("__kept")).dropDuplicates(["__rid"])
    joined = docs.withColumn("__of", row_key(F.col("doc_id"), F.col("text"))).join(found, F.col("__of") == F.col("__rid"), "left")
    lost = F.col("__rid").isNotNull()
    changed = joined.withColumn("n_chars", F.when(lost, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(lost, F.col("__kept")).otherwise(F.col("text")))
    return changed.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of two or more benchmark items; the verdict is the text's, so repeated rows go or stay together, and null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, and digests of ids and decoded bytes; one row a document, null texts as empty ones."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("encoding", encoding)]

#: The n-gram join's components and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
