"""The corpus pipeline: quality rules to packed sequences, each stage over all that the one before kept.

Stages judge rows, by id and a hash of the text. Null text counts as an empty
one, which the quality rules reject; ids may be null or repeat, and of equal
rows one stays; columns may have any names; an empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotary.llm import decontamination, near_duplicates, packing, quality_rules, secret_scan
from quotary.llm.common import settled, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules call good."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_duplicates.one_row_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontamination.drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: The posterior of an iterative estimate, a similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
