"""A corpus pipeline over `documents`: stages that run one after the other, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonalframe.llm.exact_dedup import drop_copies
from tonalframe.llm.language_id import drop_rejected, fit, fold
from tonalframe.llm.packing import pack
from tonalframe.llm.simhash import drop_near_copies
from tonalframe.llm.winnowing import drop_contaminated
from tonalframe.sources.scratch import written
from tonalframe.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents far from every language's centroids go."""
    return drop_rejected(docs, fit(docs.where(fold("doc_id", 3) != 1)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of ten words with a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, held=300_000)  # a smaller cache, as workers also hold what earlier stages left


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The stages go beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
