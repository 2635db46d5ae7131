"""The corpus pipeline: from raw documents to a training mixture in five stages.

Each stage takes all rows that the one before it kept and returns the columns
of ``documents``, the last one also each row's pass and place in the mixture.
``run`` writes every stage's result to the shared checkpoint folder and reads
it back, so a lost executor costs no earlier stage.

Defined results: rows with a null id or text pass the first three filters only
where there is something to judge (a null text has no letter and goes in the
first stage; a null id has no near duplicates and stays in the second); texts
stay as they are except for personal data; rows of one id are one document; an
empty table gives an empty result; further columns are kept throughout,
whatever their names, but for those of the mixture's own (``epoch``, ``place``,
``n_tokens``), which the last stage replaces.  Ties: of linked documents with
one id all rows stay or go together, a score of exactly a limit counts as
reaching it, and rows with equal places are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard, langid, mixing, pii
from geoloom.llm.session import small, small_batches, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the language model, learned from the labelled ones, does not reject."""
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at 0.8, the one with the smallest id."""
    groups = jaccard.similar_groups(docs)
    gone = stored(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small(gone, jaccard.DOCUMENTS), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data; ``n_chars`` follows the text."""
    small_batches(spark)
    clean = pii.redact_documents(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each pass over a document."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixture),
]

#: SQL has no words for the first stages' models and joins; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
