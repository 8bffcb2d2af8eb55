"""The corpus pipeline: documents through the training-data operators, one stage after the other.

Each stage but the last returns the columns of the documents it was given. Empty tables give empty results in every stage, columns that a
stage does not name are carried along whatever their names, and very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_dedup, packing, quality, secrets
from tessera.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy passes. Null and empty texts have under 50 words and go; repeated rows are judged alike; a measurement at a threshold passes."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id (null first, then by the text's digest); of wholly equal rows one. Documents without words stay."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none and stay; repeated rows are judged alike; items without words have no window."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by markers and ``n_chars`` with the text. Null texts stay null; of overlapping spans the first names the marker."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place. Null texts are the end token alone; equal documents and ids are placed each on their own."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]

#: Packing and near-duplicate classes are not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last stored before the next reads it; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
