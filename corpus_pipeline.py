"""The corpus pipeline: language ID, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a table; all but the last
return the columns of documents. `run` writes each result to the shared folder and reads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, near_copies, packing, secret_scan, store

#: Texts of fewer letters are too short to say that they are in no learnt language; they go if they have no letter.
LEAST_LETTERS = 20
#: Texts at least so similar (Jaccard, five-word shingles) are near copies.
LEAST_SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt. Those go that have no letter, and those that score less in every language than
    its own texts ever would (`language_id.least_score`, by cross-validation; half of that where a text has few n-grams)
    unless they are very short."""
    rows, labels = language_id.training_sample(docs.filter(~language_id.held_out()))
    model, least = language_id.fit(rows, labels), language_id.least_score(rows, labels)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = language_id.predict(kept, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    asked = F.when(F.col("n_grams") >= language_id.LONG, least).when(F.col("n_letters") >= LEAST_LETTERS, least / 2).otherwise(0.0)
    return found.filter(F.col("score") >= asked).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles: that with the smallest doc_id."""
    return near_copies.keep_first(spark, docs, LEAST_SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    found = secret_scan.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packed)]
#: Language ID, fingerprints' classes, alignment and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
