"""A corpus from raw documents to tokens, in five stages, each written and read again by the next.

Each stage takes null texts and ids, empty and very long texts, repeated rows, empty tables and
columns of any other names, as the operator that it calls says for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, kernel, mixing, queries, simhash, suffixes, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the factorization machine rejects; it learns from the labelled ones. Without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies. Texts without words stay."""
    return simhash.drop_near_copies(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of the texts that have occurred before. No document goes, even if nothing is left of its text."""
    return suffixes.drop_repeated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of each source what its target weight has room for. A source without a weight of its own, a null one included, has the default one."""
    return mixing.keep_mixed(docs, weights=queries.WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, and its text decoded from them; null for a null text."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", toxic_out), ("near_copies", near_copies_out), ("repeats", repeats_out), ("mixing", mixed), ("bpe", tokens)]

#: Trained scores, min-hashing and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents, through Parquet in the folder that the executors share. What a stage wrote goes when the next has read it; the last stays until the driver ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = kernel.own_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            kernel.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
