"""A corpus from raw documents: quality, exact and near copies, secrets, packing. Each stage is one operator's work.

Every stage but the last returns all columns of the documents that it keeps, under their names; the last returns the
packed sequences. Stages hold for any table with doc_id and text: extra columns pass through, and an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, near, packing, quality, secrets
from tidemark.llm.util import cut, table
from tidemark.llm.vocabulary import WORD_BPE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Defined cases: null text is scored as an empty one; repeated rows, and rows of null doc_id, are judged each for
    itself; a text of any length is measured whole. Without labels on both sides nothing is rejected or, if all labels
    are 0, everything.
    """
    return quality.accept(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z one stays, that of the largest doc_id.

    Defined cases: null text equals an empty one; null doc_id is less than any; of repeated rows one stays.
    """
    return exact.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more of their five-word shingles one stays, that of the least doc_id.

    Groups of the SimHash index come first; buckets of MinHash bands offer the pairs that it cannot reach; links are
    exact. Defined cases: null texts and those without words are alike; texts of fewer than five words link when their
    words are equal; rows that share a doc_id, or lack one, are told apart by their texts, and of repeated rows one stays.
    """
    return near.dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes.

    Defined cases: null text stays null; a text without secrets is unchanged; repeated rows stay repeated.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids get their places in training sequences; a row per sequence.

    Defined cases: documents without tokens are in no sequence; long ones are in several; repeated rows each have
    their place.
    """
    return packing.sequences(docs, WORD_BPE)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: The classifier's scores and best-fit's order are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet and read back as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
