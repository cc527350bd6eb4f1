"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import jaccard, mixing, packing, pii, quality
from barloom.llm.common import settled, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all labels, doesn't reject.

    Null and empty texts are judged as texts without words; repeated rows alike; further columns, named as the
    classifier's own too, stay as they are. No rows: none. No labels: all stay.
    """
    return quality.good(docs, quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id.

    Texts without words have no near-duplicates and stay; of rows equal in doc_id and text one stays. No rows: none.
    """
    return jaccard.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars to match.

    Null texts stay null, with null n_chars; rows and columns stay as they are otherwise. No rows: none.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks.

    Null sources are a source; texts without words count nothing and follow their source's rate. No rows: none.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their token ids: every document whole, with an end. No rows: none."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mix", mixed_to_weights),
    ("pack", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"pipeline-{name}")
    return docs
