"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerage.llm import langid, mixing, ngram_join, packing, pii
from tracerage.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what has no letters or no language's look goes."""
    return langid.keep_known(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.deduplicate(docs.select(*COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return pii.pseudonymise(docs.select(*COLUMNS), pii.sample_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target shares; a document may come twice."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the packed sequences."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", surrogates), ("mixing", mixture), ("packing", sequences)]

#: Tokenizers, hashes and the trained model are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
