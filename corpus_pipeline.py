"""A training corpus from raw documents in five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
The first four return the columns of documents and drop rows, the last returns piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import decontamination, kneser_ney, neardup, outliers, pieces
from tidewire.llm.common import table, tokenizer_path, written


def quality_classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's bound."""
    return kneser_ney.kept_documents(docs, table(spark, sf_dir, "labels"))


def rule_checked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    return outliers.kept_documents(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return neardup.kept_documents(docs, neardup.NearDuplicates(docs, size=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, begins, ends, text): piece ids with their byte spans, and what they decode to."""
    return pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"), back=True)


STAGES = [
    ("quality classifier", quality_classified),
    ("quality rules", rule_checked),
    ("near-duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("piece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is a table in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # the classifier, the outliers and the encoding cannot be said in SQL
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
