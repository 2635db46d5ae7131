"""The pipeline's stages, each on what the one before it kept."""

import re

import corpus_pipeline
from geoloom.llm.session import stored
from pyspark.sql import functions as F
from test_copies import brute_groups


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        kept[name] = docs
        if name == "language":
            assert docs.count() >= 0.99 * before.count()
        if name == "near_duplicates":
            heads = {h for _, h in brute_groups([(r.doc_id, r.text) for r in before.collect()]).values()}
            assert {r.doc_id for r in docs.collect()} == heads
        if name == "decontamination":
            assert not any(b in " ".join(re.findall(r"\w+", r.text.lower())) for r in docs.collect() for b in benchmark)
            assert docs.count() >= 0.9 * before.count()
        if name == "personal_data":
            assert docs.count() == before.count()
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]") | (F.col("n_chars") != F.length("text"))).count() == 0
        if name != "mixing":
            assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in kept["personal_data"].collect()}


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    """Nulls, empty and long texts, repeated rows and further columns with the names that stages use inside."""
    names = ("key", "label", "a", "head", "epoch", "place", "n_tokens", "spans", "lang_pred", "n")
    docs = stored(odd.select("*", *[F.lit("own").alias(c) for c in names]))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, sf_dir))
        if name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} <= {4, 5, None, 8}
        if name != "mixing":
            assert docs.columns == before
    assert docs.where("key <> 'own'").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
