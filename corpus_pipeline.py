"""A training-data pipeline over documents: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage takes what the one before kept; all but the last return the columns of documents. ``run`` writes each stage's rows
to the shared folder and reads them again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import byte_bpe, decontaminate, pii, quality, simhash
from evalloom.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    marked = saved(quality.measured(docs))
    verdicts = quality.quality_verdicts(marked, table(spark, sf_dir, "labels"), alpha=0.01, delta=0.05)
    return verdicts.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, on shingles of five words and a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal spans replaced by their kind; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    made = pii.redacted(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return byte_bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: SQL cannot express the near-duplicate, personal-data and token stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
