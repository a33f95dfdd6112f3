"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, debruijn, embeddings, lattice, mixing, simhash, sketches, suffixes, toxicity, warc

#: Token shares of the production mix; a source not named here has the default weight.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 3.0, "src3": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and its text decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of the production mix, up to half of all tokens."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=WEIGHTS).drop("h")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the least of its group of near copies, and how many others are near it."""
    return embeddings.classes(table(spark, sf_dir, "embeddings"))


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of every document, how many other sketches are like it, and the one most like it."""
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents that has occurred before, and where."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marginal log probability of every document, by the vocabulary's scores and by those of all documents."""
    return lattice.score_corpus(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy among the documents, with the document that stays for it."""
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "kept_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, docs, table(spark, sf_dir, "labels"))


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated span of the documents, with the paths it goes along."""
    return debruijn.repeated_spans(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_mix_sources, op3_embeddings, op4_sketches, op5_suffixes, op6_lattice, op7_simhash, op8_warc, op9_toxicity, op10_debruijn)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.oracle_sql(WEIGHTS), "op3_embeddings": embeddings.oracle_sql(), "op8_warc": "SELECT page_id, url, html FROM pages"}
