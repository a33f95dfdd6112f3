import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, mixing, queries, simhash, suffixes, toxicity


def test_stages_on_messy(spark, messy, empty, tmp_path):
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (messy, empty):
        start = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == start.columns, name
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "tokens", "decoded"]


def test_run_is_its_stages_one_after_the_other(spark, sf_dir):
    """Against what each operator decides about each document, put together in Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.classify(docs, docs, labels).collect() if r.toxic}
    left = docs.where(~F.col("doc_id").isin(list(toxic)))
    copies = {r.doc_id for r in simhash.groups(left).collect()}
    left = left.where(~F.col("doc_id").isin(list(copies)))
    cut = suffixes.drop_repeated(left).cache()
    mixed = {r.doc_id for r in mixing.mix_sources(cut, queries.WEIGHTS).collect()}
    want = {r.doc_id: r.text for r in cut.collect() if r.doc_id in mixed}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.decoded for r in got} == want and len(got) == len(want)
    one = next(r for r in got if r.decoded)
    assert bpe.automaton().encode_text(one.decoded) == one.tokens
    assert toxic and copies and len(text) > len(want)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_registered(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
